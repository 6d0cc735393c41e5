"""Occupation and level of a title, as ordered rules over Columns.

Patterns are tested in the JVM, each once a title; callers that have many rows for one title classify distinct titles and
join (:func:`gleaner.operators.lookups.occupations`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wordings of titles.
SOFTWARE = (
    r"(?i)\b("
    r"software\s*(engineer|developer|dev|development\s*engineer)|swe\b|full[- ]?stack|front[- ]?end\s*(engineer|developer)|back[- ]?end\s*(engineer|developer)|"
    r"web\s*(developer|engineer)|mobile\s*(developer|engineer)|devops\s*(engineer)?|platform\s*engineer|data\s*engineer|ml\s*engineer|machine\s*learning\s*engineer|"
    r"site\s*reliability\s*(engineer)?|ai\s*engineer|llm\s*engineer|agent\s*engineer|applied\s*(ai|ml)\s*engineer|prompt\s*engineer|infrastructure\s*engineer|"
    r"cloud\s*engineer|application\s*(developer|engineer)|software\s*architect|(?:mainframe|salesforce|service\s*now|servicenow)\s*(developer|engineer)|"
    r"founding\s*engineer|member\s*of\s*technical\s*staff|product\s*engineer|systems?\s*engineer|"
    r"(python|java(?!script)|javascript|typescript|ruby|golang|go(?=\s*(developer|engineer|dev|programmer))|rust|kotlin|swift|scala|elixir|php|perl|clojure|haskell|dart|"
    r"lua|csharp|c\+\+|dotnet)\s*(developer|engineer|dev|programmer)|"
    r"gui\s*(developer|engineer)|react(\s*native)?\s*(developer|engineer)|ios\s*(developer|engineer)|android\s*(developer|engineer)"
    r")\b"
)
NOT_SOFTWARE = (
    r"(?i)\b("
    r"sales\s*engineer|support\s*engineer|field\s*(service|engineer)|customer\s*(success|support)\s*engineer|solutions?\s*(architect|engineer)|systems?\s*administrator|"
    r"civil\s*engineer|mechanical\s*engineer|electrical\s*engineer|chemical\s*engineer|industrial\s*engineer|audio\s*engineer|recording\s*engineer|sound\s*engineer|"
    r"network\s*engineer|hardware\s*engineer|(electrical|hardware|mechanical|rf|avionics|controls?)\s*systems?\s*engineer|"
    r"systems?\s*engineer\s*[-–—,]\s*(electrical|hardware|mechanical|rf|avionics)"
    r")\b"
)
ADJACENT = (
    r"(?i)\b("
    r"(?:network|cloud\s+network)\s*engineer|"
    r"(?:security|cyber\s*security|cybersecurity|information\s*security|application\s*security|network\s*security|cloud\s*security|infrastructure\s*security)\s*engineer|"
    r"(?:systems?|cloud|linux|windows)\s*administrator|(?:database|sql\s*database|oracle\s*database)\s*administrator|(?:vmware|sap\s*basis|windows)\s*engineer|"
    r"data\s*scientist|(?:cloud|application|security|data|technical|infrastructure|salesforce|service\s*now|servicenow)\s*architect|network\s*engineering"
    r")\b"
)
CONTROL = r"(?i)\b(civil\s*engineer|mechanical\s*engineer|nurse|registered\s*nurse|nursing|electrical\s*engineer|chemical\s*engineer|accountant|accounting|financial\s*analyst)\b"
TECHNICAL = (
    r"(?i)\b("
    r"engineer|developer|architect|programmer|coder|coding|technical|tech|software|swe|devops|full.?stack|front.?end|back.?end|data|machine.?learn|ml\b|ai\b|llm|"
    r"cloud|infrastructure|platform|site.?reliab|sre|embedded|firmware|mobile|web|app|application|systems?|administrator|database|computing|computer|cyber|security|"
    r"automation|qa\b|quality\s*assur|test|blockchain|crypto|defi|smart.?contract|python|java|javascript|typescript|react|node|golang|rust|ruby|scala|kotlin|swift|"
    r"elixir|haskell|clojure|dart|lua|perl|oracle|sap|vmware|gui|react|ios|android|it\b|information\s*tech"
    r")\b"
)
#: Least similarity to a known title of software engineering, and of a neighbouring occupation.
SIMILAR, NEIGHBOURING = 0.85, 0.70
#: Sureness of a curated label, and of the pattern of neighbouring occupations.
CURATED = {"SWE": 0.90, "SWE_ADJACENT": 0.85, "NOT_SWE": 0.90}
ADJACENT_SURENESS = 0.82
INTERN = r"(?i)\b(intern|internship|co-?op)\b"
DIRECTOR = r"(?i)\b(director|vp|vice\s*president|head\s+of|chief|cto|cio)\b"
SENIOR = r"(?i)\b(senior|sr\.?|staff|principal|distinguished|fellow|architect)\b"
LEAD = (
    r"(?i)\b(tech\s*lead|engineering\s*lead|"
    r"lead\s+(?:software|data|platform|backend|back[- ]?end|frontend|front[- ]?end|full[- ]?stack|devops|qa|test|ml|ai|cloud|infrastructure|systems?))\b"
)
JUNIOR = r"(?i)\b(junior|jr\.?|new\s*grad(?:uate)?|recent\s*grad(?:uate)?|fresh\s*grad(?:uate)?|entry[- ]?level|early\s*career)\b"
MANAGER = r"(?i)\b(manager|supervisor)\b"
ANY_LEAD = r"(?i)(^|[\s,/:()\-])lead\b|\blead(?=[\s,/:()\-]|$)"
#: Families in which a manager or lead is known to be one of the trade, by what else the title must name.
TRADES = {
    "adjacent": r"(?i)\b(qa|quality|test|network|data|application|infrastructure|architect|analyst|security|ui|ux|web|cloud|automation|systems?|reliability|analytics?|mlops)\b",
    "control": r"(?i)\b(nurse|rn\b|nursing|nurse\s*practitioner|accountant|accounting|financial\s*analyst|civil|mechanical|electrical|chemical|engineer)\b",
}


def occupation(key: Column, raw: Column, curated: Column, similarity: Column | None = None) -> Column:
    """A struct of is_swe, is_swe_adjacent, confidence and tier.

    ``key``: the technical title key; ``raw``: the title in lower case; ``curated``: the label of a curated table, if it
    has the key; ``similarity``: the key's largest similarity to known titles, from any encoder. A key that names
    software engineering comes first, then control occupations, curated labels, neighbouring occupations, and similarity
    for what sounds technical.
    """

    def told(swe: bool, adjacent: bool, sure: Column | float, tier: str) -> Column:
        sure = sure if isinstance(sure, Column) else F.lit(sure)
        return F.struct(F.lit(swe).alias("is_swe"), F.lit(adjacent).alias("is_swe_adjacent"), sure.cast("double").alias("confidence"), F.lit(tier).alias("tier"))

    near = F.when(key.rlike(TECHNICAL), similarity if similarity is not None else F.lit(None).cast("double"))
    named = F.when(key.rlike(SOFTWARE) & ~key.rlike(NOT_SOFTWARE), told(True, False, 1.0, "regex")).when(raw.rlike(CONTROL), told(False, False, 1.0, "regex"))
    for label, sure in CURATED.items():
        named = named.when(curated == label, told(label == "SWE", label == "SWE_ADJACENT", sure, "title_lookup_llm"))
    named = named.when(key.rlike(ADJACENT), told(False, True, ADJACENT_SURENESS, "regex"))
    named = named.when(near >= SIMILAR, told(True, False, near, "embedding_high")).when(near >= NEIGHBOURING, told(False, True, near, "embedding_adjacent"))
    return named.otherwise(told(False, False, F.coalesce(near, F.lit(0.0)), "unresolved"))


def exclusive(swe: Column, adjacent: Column, control: Column) -> Column:
    """A struct of three flags of which one holds at most: software engineering before neighbours before controls."""
    swe, adjacent, control = (F.coalesce(c, F.lit(False)) for c in (swe, adjacent, control))
    return F.struct(swe.alias("is_swe"), (adjacent & ~swe).alias("is_swe_adjacent"), (control & ~swe & ~adjacent).alias("is_control"))


def family(swe: Column, adjacent: Column, control: Column) -> Column:
    """The family that a title's level is read in: control, adjacent, swe or other."""
    out = F.lit("other")
    for name, c in (("swe", swe), ("adjacent", adjacent), ("control", control)):
        out = F.when(F.coalesce(c, F.lit(False)), name).otherwise(out)
    return out


def title_level(title: Column, of: Column) -> Column:
    """A struct of level and source, from the strong words of a title only; "unknown" without any.

    Managers and leads count where the family ``of`` has a trade that the title names.
    """
    title = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    trade = F.lit(False)
    for name, pattern in TRADES.items():
        trade = trade | ((of == name) & title.rlike(pattern))
    rules = (
        (title.rlike(INTERN), "entry", "title_keyword"),
        (title.rlike(DIRECTOR), "director", "title_keyword"),
        (title.rlike(SENIOR), "mid-senior", "title_keyword"),
        (trade & (title.rlike(MANAGER) | title.rlike(ANY_LEAD)), "mid-senior", "title_manager"),
        (title.rlike(LEAD), "mid-senior", "title_keyword"),
        (title.rlike(JUNIOR), "entry", "title_keyword"),
    )
    struct = lambda level, source: F.struct(F.lit(level).alias("level"), F.lit(source).alias("source"))
    out = struct("unknown", "unknown")
    for test, level, source in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), struct(level, source)).otherwise(out)
    return out


def eligible(platform: Column, english: Column, description: Column, group: Column, platforms: tuple[str, ...] = ("linkedin",), words: int = 15) -> Column:
    """Whether a posting may enter the frame: a platform of those given, English, a description of ``words`` words or more,
    and in one of the groups. Unknown counts as no."""
    enough = F.size(F.filter(F.split(F.coalesce(description, F.lit("")), r"\s+"), lambda w: w != "")) >= words
    out = platform.isin(*platforms) & english & enough & group
    return F.coalesce(out, F.lit(False))


def combined_label(label: Column) -> Column:
    """Whether a label says software engineering or a neighbour of it; no label says nothing."""
    return F.when(label.isNotNull(), label.isin("SWE", "SWE_ADJACENT"))
