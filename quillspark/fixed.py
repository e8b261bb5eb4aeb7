"""Fixed values of the legal corpus: codes, names, ranges and reigns.

All of these are facts of the data that queries must agree with, stated as they
are.
"""

from __future__ import annotations

BASE_URI = "http://www.legislation.gov.uk/id/"
SITE = "http://www.legislation.gov.uk/"

# Code, full name, first and last year of each type of legislation.
TYPES: list[tuple[str, str, int, int]] = [
    ("ukpga", "UK Public General Act", 1801, 9999),
    ("asp", "Act of the Scottish Parliament", 1999, 9999),
    ("asc", "Act of Senedd Cymru", 2020, 9999),
    ("anaw", "Act of the National Assembly for Wales", 2012, 2020),
    ("wsi", "Wales Statutory Instrument", 2012, 9999),
    ("uksi", "UK Statutory Instrument", 1948, 9999),
    ("ssi", "Scottish Statutory Instrument", 1999, 9999),
    ("ukcm", "Church Measure", 1920, 9999),
    ("nisr", "Northern Ireland Statutory Rule", 2000, 9999),
    ("nia", "Northern Ireland Act", 2000, 9999),
    ("eudn", "EU Decision", 1973, 2020),
    ("eudr", "EU Directive", 1973, 2020),
    ("eur", "EU Regulation", 1973, 2020),
    ("ukla", "UK Local Act", 1797, 9999),
    ("ukppa", "UK Private and Personal Act", 1539, 9999),
    ("apni", "Act of the Northern Ireland Parliament", 1921, 1972),
    ("gbla", "Local Act of the Parliament of Great Britain", 1797, 1800),
    ("aosp", "Act of the Old Scottish Parliament", 1424, 1707),
    ("aep", "Act of the English Parliament", 1267, 1707),
    ("apgb", "Act of the Parliament of Great Britain", 1707, 1800),
    ("mwa", "Measure of the Welsh Assembly", 2008, 2011),
    ("aip", "Act of the Old Irish Parliament", 1495, 1800),
    ("mnia", "Measure of the Northern Ireland Assembly", 1974, 1974),
    ("nisro", "Northern Ireland Statutory Rule and Order", 1922, 1974),
    ("nisi", "Northern Ireland Order in Council", 1974, 9999),
    ("uksro", "UK Statutory Rule and Order", 1894, 1947),
    ("ukmo", "UK Ministerial Order", 1800, 9999),
    ("ukci", "Church Instrument", 1991, 9999),
]
TYPE_CODES = [t[0] for t in TYPES]

# Types of each category.
CATEGORIES: dict[str, list[str]] = {
    "primary": ["ukpga", "asp", "asc", "anaw", "ukcm", "nia"],
    "secondary": ["wsi", "uksi", "ssi", "nisr"],
    "european": ["eudn", "eudr", "eur"],
}

# Territorial extent codes and names.
EXTENTS: dict[str, str] = {
    "E": "England",
    "W": "Wales",
    "S": "Scotland",
    "N.I.": "Northern Ireland",
    "NI": "Northern Ireland",
    "E+W+S+N.I.": "United Kingdom",
    "E+W+S+N.I": "United Kingdom",
    "E+W+S+NI": "United Kingdom",
}

# Sovereign, year of accession, last year.
REIGNS: list[tuple[str, int, int]] = [
    ("Hen3", 1216, 1272), ("Edw1", 1272, 1307), ("Edw2", 1307, 1327), ("Edw3", 1327, 1377), ("Ric2", 1377, 1399), ("Hen4", 1399, 1413),
    ("Hen5", 1413, 1422), ("Hen6", 1422, 1461), ("Edw4", 1461, 1483), ("Edw5", 1483, 1483), ("Ric3", 1483, 1485), ("Hen7", 1485, 1509),
    ("Hen8", 1509, 1547), ("Edw6", 1547, 1553), ("Mar1", 1553, 1558), ("Eliz1", 1558, 1603), ("Jas1", 1603, 1625), ("Cha1", 1625, 1649),
    ("Cha2", 1660, 1685), ("Will3", 1689, 1702), ("WillandMar", 1689, 1694), ("Ann", 1702, 1714), ("Geo1", 1714, 1727), ("Geo2", 1727, 1760),
    ("Geo3", 1760, 1820), ("Geo4", 1820, 1830), ("Will4", 1830, 1837), ("Vict", 1837, 1901), ("Edw7", 1901, 1910), ("Edw8", 1936, 1936),
    ("Geo5", 1910, 1936), ("Geo6", 1936, 1952), ("Eliz2", 1952, 2022),
]

# Other spellings of sovereigns; names that need a number stand for none.
SPELLINGS: dict[str, str | None] = {
    "victoria": "Vict", "victoriae": "Vict", "vic": "Vict", "edwvii": "Edw7", "chas1": "Cha1", "chas2": "Cha2", "jas2": "Jas1", "ja1": "Jas1",
    "ja2": "Jas1", "anne": "Ann", "ric3": "Ric2", "eliz": "Eliz1", "mary": "Mar1", "willandmarsess2": "WillandMar", "philandmar": "Mar1",
    "philandmarsess": "Mar1", "george": None, "edward": None, "henry": None, "william": None, "charles": None, "james": None, "richard": None, "elizabeth": None,
}

# Words that begin a provision in a URI.
PROVISIONS = ["section", "schedule", "article", "regulation", "rule", "paragraph", "part", "chapter", "crossheading"]

# Headings of explanatory notes, in order of precedence, and their note type.
NOTE_TYPES: list[tuple[str, str]] = [
    ("Introduction", "overview"),
    ("Overview", "overview"),
    ("Overview of the Act", "overview"),
    ("Summary", "overview"),
    ("Background", "overview"),
    ("Summary and Background", "overview"),
    ("Background and Summary", "overview"),
    ("Territorial Application", "extent"),
    ("Commentary on Sections", "provisions"),
    ("Commentary", "provisions"),
    ("Commencement", "commencement"),
    ("Policy background", "policy_background"),
    ("Legal background", "legal_background"),
    ("Territorial extent and application", "extent"),
    ("Section", "provisions"),
    ("Schedule", "provisions"),
    ("Part", "provisions"),
]

# Courts and their divisions.
COURTS = ["uksc", "ukpc", "ewca", "ewhc", "ewcr", "ewcc", "ewfc", "ewcop", "ukiptrib", "eat", "ukut", "ukftt"]
DIVISIONS = ["civ", "crim", "t3", "admin", "admlty", "ch", "comm", "fam", "ipec", "kb", "mercantile", "pat", "scco", "tcc", "qb", "costs", "aac", "iac", "lc", "grc", "tc", "b", "t2"]

# Courts in full, for citations.
COURT_NAMES: dict[str, str] = {
    "uksc": "UK Sup. Ct.",
    "ukpc": "Privy Council",
    "ewca": "Eng. & Wales Ct. App.",
    "ewhc": "Eng. & Wales High Ct.",
    "ewcr": "Crown Ct.",
    "ewcc": "County Ct.",
    "ewfc": "Fam. Ct.",
    "ukut": "Upper Trib.",
    "ukftt": "First-tier Trib.",
}

# Kinds of clients and words of their names, in order of precedence.
AGENTS: list[tuple[str, list[str]]] = [
    ("curl", ["curl"]),
    ("postman", ["postman"]),
    ("insomnia", ["insomnia"]),
    ("python_client", ["python"]),
    ("javascript_client", ["node", "javascript"]),
    ("web_browser", ["chrome", "firefox", "safari", "edge"]),
    ("bot", ["bot", "crawler"]),
    ("ai_agent", ["mcp", "claude"]),
]
