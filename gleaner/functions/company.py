"""Company names: agencies that post for others, the employers behind them, and names made comparable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Agencies by name and by pattern, wordings that introduce an employer, words of no employer's name,
# abbreviations, generic words, organisations' words, names that are never merged, and aliases.
AGENCIES = (
    "lensa", "jobs via dice", "dice", "jobot", "cybercoders", "hired", "ziprecruiter", "talentally", "ladders", "efinancialcareers", "ventureloop", "builtin",
    "jobs for humanity", "jobs via efinancialcareers", "clearancejobs", "clickjobs.io", "actalent", "randstad", "robert half", "teksystems", "kforce",
    "insight global", "motion recruitment", "harnham", "apex systems", "modis", "experis", "manpowergroup", "kelly services", "adecco", "hays", "michael page",
    "collabera", "infosys bpm", "wipro", "tata consultancy", "tata consultancy services", "tata consultancy services (tcs)", "cognizant", "capgemini",
    "revature", "smoothstack", "recruiting from scratch", "aston carter", "solomon page", "turing", "creative circle", "applicantz", "aditi consulting",
    "ask consulting", "inspyr solutions", "net2source inc.", "net2source inc", "net2source", "dataannotation", "data annotation", "appen", "scale ai",
    "remotasks", "clickworker",
)
AGENCY_PATTERNS = (
    r"\blensa\b", r"\bjobs?\s+via\b", r"\bjobs?\s*via\s*dice\b", r"\bjobs?\s*via\s*efinancialcareers\b", r"\b(dice|dice\.com)\b", r"\bjobot\b", r"\bcybercoders\b",
    r"\bclickjobs(?:\.io)?\b", r"\bclearancejobs\b", r"\bziprecruiter\b", r"\bjobs?\s+for\s+humanity\b", r"\bactalent\b", r"\baston\s*carter\b", r"\brandstad\b",
    r"\brobert\s*half\b", r"\bteksystems\b", r"\bkforce\b", r"\binsight\s*global\b", r"\bapex\s*systems\b", r"\bsolomon\s+page\b", r"\bcreative\s+circle\b",
    r"\brecruiting\s+from\s+scratch\b", r"\bdata\s*annotation\b", r"\brevature\b", r"\bsmoothstack\b", r"\btalentally\b", r"\bharnham\b",
    r"\bmotion\s*recruitment\b", r"\baditi\s+consulting\b", r"\bask\s+consulting\b", r"\binspyr\s+solutions\b", r"\bnet2source(?:\s+inc\.?)?\b",
    r"\btata\s+consultancy(?:\s+services)?(?:\s+\(tcs\))?\b", r"\bapplicantz\b", r"\bturing\b(?!\s+(pharmaceutical|medical))",
)
EMPLOYER_WORDINGS = (
    r"(?i)our\s+client[,:]?\s*([A-Z][A-Za-z0-9\s&.,-]+?)(?:,|\s+is|\s+has|\s+seeks|\s+needs|\.)",
    r"(?i)on\s+behalf\s+of\s+([A-Z][A-Za-z0-9\s&.,-]+?)(?:,|\s+is|\s+we|\.)",
    r"(?i)partner(?:ed|ing)\s+with\s+([A-Z][A-Za-z0-9\s&.,-]+?)(?:,|\s+to|\s+for|\.)",
    r"(?i)working\s+with\s+([A-Z][A-Za-z0-9\s&.,-]+?)\s+(?:to\s+find|who\s+is|looking)",
    r"(?i)(?:job|position|role)\s+(?:is\s+)?(?:with|at|for)\s+([A-Z][A-Za-z0-9\s&.,-]+?)(?:\.|,|\s+in\b|\s+located)",
)
NO_EMPLOYER = (
    r"(?i)\b(client|clients|company|companies|organization|team|role|position|opportunity|seeking|looking|hiring|available|access|extension|contract|"
    r"engineer|developer|manager|director|architect|scientist|analyst|specialist|consultant|administrator|technician|recruiter|designer|"
    r"located|location|remote|hybrid|onsite|site|week|weeks|sector|industry|ownership|detail\s+oriented|direct\s+client|integrators)\b"
)
ORGANISATION = (
    r"(?i)\b(inc|llc|ltd|corp|corporation|company|co|group|systems|solutions|technologies|technology|labs|lab|health|partners|holdings|bank|"
    r"university|international|networks|software|services)\.?\b"
)
FRAGMENT = r"(?i)^(in|at|for|with|to|on|of|from)\b"
#: Characters of a description that are read, and of the shortest that is; lengths of an employer's name; words of it.
READ, SHORTEST, NAME, NAME_WORDS = 2000, 50, (3, 79), 6
ABBREVIATIONS = {
    "intl": "international", "natl": "national", "ctr": "center", "dept": "department", "svc": "services", "svcs": "services", "mgmt": "management",
    "mfg": "manufacturing", "engr": "engineering", "engrg": "engineering", "sys": "systems", "assoc": "associates", "govt": "government", "univ": "university",
}
GENERIC = (
    "health", "care", "solutions", "services", "group", "systems", "consulting", "staffing", "medical", "network", "digital", "financial", "management", "energy",
    "national", "american", "general", "united", "first", "professional", "advanced", "technology", "technologies", "tech", "global", "partners", "associates",
    "international", "resources", "insurance",
)
PUBLIC_BODIES = (
    "university", "college", "hospital", "medical", "center", "school", "district", "community", "county", "city", "state", "church", "bank", "credit", "union",
    "association", "society", "foundation", "institute", "academy", "clinic",
)
PROTECTED = ("appleone", "applebees", "apple bank", "applegate", "apple roofing", "apple federal credit union", "apple hospitality", "apple leisure group")
ALIASES = {
    "Amazon": ("amazon", "amazon.com", "amazon.com inc", "amazon.com inc.", "amazon web services", "aws", "amazon.com services"),
    "Google": ("google", "alphabet", "alphabet inc", "alphabet inc.", "google llc", "google cloud", "google deepmind"),
    "Meta": ("meta", "meta platforms", "meta platforms inc", "facebook", "facebook inc"),
    "Microsoft": ("microsoft", "microsoft corporation", "microsoft corp"),
    "JPMorgan Chase & Co.": (
        "jpmorgan chase", "jpmorganchase", "jpmorgan chase & co", "jpmorgan chase & co.", "jpmorgan chase and co", "jpmorganchaseco", "jp morgan chase", "jp morgan",
        "jpmc", "j.p. morgan", "j p morgan",
    ),
    "Apple": ("apple", "apple inc", "apple inc."),
    "IBM": ("ibm", "international business machines", "international business machines corp", "international business machines corporation"),
    "Deloitte": ("deloitte consulting", "deloitte llp", "deloitte touche tohmatsu", "deloitte & touche"),
    "PricewaterhouseCoopers": ("pwc", "pricewaterhousecoopers llp", "pricewaterhousecoopers"),
    "Ernst & Young": ("ey", "ernst & young llp", "ernst and young"),
    "McKinsey & Company": ("mckinsey", "mckinsey and company", "mckinsey & co"),
    "Accenture": ("accenture llp", "accenture federal services"),
    "Bank of America": ("bank of america corp", "bank of america corporation", "bofa securities"),
    "Wells Fargo": ("wells fargo & company", "wells fargo bank"),
    "Goldman Sachs": ("goldman sachs & co", "the goldman sachs group", "goldman sachs group"),
    "Morgan Stanley": ("morgan stanley & co",),
    "Citigroup": ("citibank", "citi"),
}

#: Legal forms that a name may end in; own list, the longest first where one ends another.
LEGAL_FORMS = (
    "incorporated", "inc", "limited liability company", "l.l.c", "llc", "corporation", "corp", "company", "co", "limited", "ltd", "plc", "gmbh", "ag", "s.a", "sa",
    "n.v", "nv", "b.v", "bv", "llp", "l.p", "lp", "pte", "pty", "oy", "ab", "kg", "srl", "spa",
)


def is_agency(name: Column) -> Column:
    """Whether a company posts for others: by its whole name, or by a pattern. No name, no agency."""
    whole = F.lower(F.trim(name)).isin(*AGENCIES)
    return F.coalesce(whole | name.rlike("(?i)" + "|".join(AGENCY_PATTERNS)), F.lit(False))


def is_organisation(name: Column) -> Column:
    """Whether a text looks like the name of an organisation: few words, and a legal word or capitals."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"\p{Lu}")))
    enough = F.when(F.size(words) == 1, (capitals == 1) & name.rlike(r"^\p{L}+$")).otherwise(capitals >= 2)
    return ~name.rlike(FRAGMENT) & F.size(words).between(1, NAME_WORDS) & (name.rlike(ORGANISATION) | enough)


def real_employer(description: Column, company: Column) -> Column:
    """The employer that an agency's description names: of the wordings, in order, the first whose name is one; else null."""
    head = F.substring(description, 1, READ)

    def named(pattern: str) -> Column:
        found = F.regexp_extract(head, pattern, 1)
        bare = F.regexp_replace(F.regexp_replace(found, r"^[ \t\n\r\-.,:;()\[\]{}\"']+|[ \t\n\r\-.,:;()\[\]{}\"']+$", ""), r"\s+", " ")
        good = F.length(bare).between(*NAME) & bare.rlike(r"\p{Lu}") & is_organisation(bare) & ~bare.rlike(NO_EMPLOYER) & ~is_agency(bare)
        return F.when(good & (F.lower(bare) != F.lower(F.coalesce(company, F.lit("")))), bare)

    return F.when(F.length(description) >= SHORTEST, F.coalesce(*[named(p) for p in EMPLOYER_WORDINGS]))


def effective_company(agency: Column, employer: Column, company: Column) -> Column:
    """The employer behind an agency where there is one, else the company."""
    return F.when(agency & (F.trim(employer) != ""), employer).otherwise(company)


def comparable(name: Column) -> Column:
    """A name for comparisons: lower case, without legal form, marks and quotes, abbreviations spelled out, "and" as "&"."""
    forms = "|".join(f.replace(".", r"\.") for f in LEGAL_FORMS)
    out = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.regexp_replace(out, rf"(?:[\s,]+(?:{forms})\.?)+$", "")
    for pattern, new in ((r"['`]", ""), (r"[()\[\]{}/\\]", " "), (r"[.,;:!?\"#*]", " "), (r"\s+and\s+", " & ")):
        out = F.regexp_replace(out, pattern, new)
    out = reduce(lambda c, kv: F.regexp_replace(c, rf"\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), out)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"^[,.\-\s]+|[,.\-\s]+$", ""))


def block(name: Column) -> Column:
    """The beginning that names must share to be compared; "the " does not count."""
    return F.substring(F.regexp_replace(name, "^the ", ""), 1, 4)
