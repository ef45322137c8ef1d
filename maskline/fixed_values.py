"""Word lists, tables and constants that results depend on.

They are public facts (street vocabulary, registry lengths, numbering plans) or configuration values that must be
equal wherever the same texts and calls are processed. Kept together, as plain text.
"""

# --- Masking policy -------------------------------------------------------------------------------------------

MASKED_ENTITIES = [
    "PERSON", "LOCATION", "FR_ADDRESS", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "CRYPTO",
    "IP_ADDRESS", "FR_NIR", "FR_FISCAL_NUMBER",
]
SCORE_THRESHOLD = 0.4
CONTEXT_BOOST = 0.35
CONTEXT_MIN_SCORE = 0.4
CONTEXT_WORDS_BEFORE = 5

# Scores of French names: after a title or alone on a line, first name with others, first name alone.
NAME_SCORE_STRONG = 0.85
NAME_SCORE_FULL = 0.6
NAME_SCORE_FIRST_ALONE = 0.3

# --- French vocabulary ----------------------------------------------------------------------------------------

STREET_TYPES = [
    "rue", "avenue", "av.", "boulevard", "bd", "place", "chemin", "allée", "impasse", "quai", "route", "cours",
    "square", "passage", "faubourg", "chaussée", "voie", "sentier", "hameau", "lieu-dit", "résidence", "promenade",
    "esplanade", "cité", "villa", "parvis", "rond-point",
]
STREET_LINKS = [
    "de la", "de l['’]", "des", "du", "de", "d['’]", "la", "le", "les", "l['’]", "aux", "au", "et", "sur", "sous", "en",
]
CITY_LINKS = ["sur", "sous", "en", "lès", "les", "la", "le", "de", "du", "des", "d['’]"]
PERSON_TITLES = [
    "Mme", "Mlle", "Madame", "Mademoiselle", "Monsieur", "Docteur", "Dr", "Maître", "Me", "Professeur", "Pr",
]
PERSON_FIELDS = ["nom", "prénom", "nom de famille", "nom d'usage", "nom de naissance"]

# --- Context words per recognizer ------------------------------------------------------------------------------

CONTEXT_NIR = ["sécurité", "sociale", "sécu", "nir", "insee", "vitale", "assuré"]
CONTEXT_FISCAL = ["fiscal", "impôt", "imposition", "spi", "revenus"]
CONTEXT_ADDRESS = ["adresse", "domicil", "demeur", "habit", "postal", "situé", "résid"]
CONTEXT_IBAN_FR = ["iban", "rib", "compte", "bancaire", "virement", "prélèvement", "banque"]
CONTEXT_IBAN_EN = ["iban", "bank", "transaction"]
CONTEXT_PHONE_FR = ["téléphon", "tél", "portable", "mobile", "fixe", "appel", "joign", "joindre"]
CONTEXT_PHONE_EN = ["phone", "number", "telephone", "cell", "cellphone", "mobile", "call"]
CONTEXT_CARD = [
    "credit", "card", "visa", "mastercard", "cc ", "amex", "discover", "jcb", "diners", "maestro", "instapayment",
    "carte", "bancaire", "cb", "paiement", "débit",
]
CONTEXT_CRYPTO = ["wallet", "btc", "bitcoin", "crypto"]
CONTEXT_EMAIL = ["email"]
CONTEXT_IP = ["ip", "ipv4", "ipv6"]
CONTEXT_URL = ["url", "website", "link"]
CONTEXT_DATE = ["date", "birthday"]
CONTEXT_PERSON = [
    "salut", "coucou", "bonjour", "bonsoir", "cher", "fils", "fille", "mari", "femme", "épouse", "époux",
    "frère", "sœur", "enfant", "ami", "collègue", "gestionnaire", "manager", "assuré", "salarié", "soussign",
    "prénom", "signé", "cordialement",
]

# --- Labels of an outside named-entity model -------------------------------------------------------------------

MODEL_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION", "FAC": "LOCATION",
    "LOCATION": "LOCATION", "NORP": "NRP", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION",
    "DATE": "DATE_TIME", "TIME": "DATE_TIME",
}
IGNORED_LABELS = [
    "ORGANIZATION", "MISC", "CARDINAL", "EVENT", "LANGUAGE", "LAW", "MONEY", "ORDINAL", "PERCENT", "PRODUCT",
    "QUANTITY", "WORK_OF_ART",
]
LOW_CONFIDENCE_LABELS = ["ORG", "ORGANIZATION"]
LOW_CONFIDENCE_FACTOR = 0.4

# --- Public registries -----------------------------------------------------------------------------------------

# Total IBAN length -> countries (public IBAN registry).
IBAN_COUNTRIES = {
    15: ["NO"], 16: ["BE"], 18: ["DK", "FI", "FO", "GL", "NL", "SD"], 19: ["MK", "SI"],
    20: ["AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"], 21: ["CH", "HR", "LI", "LV"],
    22: ["BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"], 23: ["AE", "GI", "IL", "IQ", "OM", "SO", "TL"],
    24: ["AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"], 25: ["LY", "PT", "ST"],
    26: ["IS", "TR"], 27: ["BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"],
    28: ["AL", "AZ", "BY", "CY", "DO", "EG", "GT", "HU", "LB", "NI", "PL", "SV"],
    29: ["BR", "PS", "QA", "UA"], 30: ["JO", "KW", "MU", "YE"], 31: ["MT", "SC"], 32: ["LC"], 33: ["RU"],
}
# Country calling code -> shortest and longest national number (public numbering plans).
CALLING_CODES = {
    "1": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "34": (9, 9),
    "36": (8, 9), "39": (8, 11), "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10),
    "47": (8, 8), "48": (9, 9), "49": (7, 11), "52": (10, 10), "55": (10, 11), "61": (9, 9), "64": (8, 10),
    "65": (8, 8), "81": (9, 10), "82": (8, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "212": (9, 9),
    "213": (8, 9), "216": (8, 8), "351": (9, 9), "352": (6, 9), "353": (7, 9), "358": (6, 11), "420": (9, 9),
    "971": (8, 9), "972": (8, 9),
}
# First digits of valid French national numbers, after the leading 0 (public numbering plan).
FR_NUMBER_PREFIXES = [
    "1[0-9]", "2[0-57-9]", "26[013-9]", "3[0-9]", "4[1-9]", "5[0-8]", "59[1-35-9]", "6[0-8]", "69[589]", "7[3-9]",
    "80[0-9]", "81[0-9]", "82[0-9]", "83[03-69]", "84[0-9]", "85[0-9]", "86[0-9]", "88[4]", "89[0-9]", "9[0-9]",
]
TOP_LEVEL_DOMAINS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "blog", "shop",
    "online", "site", "tech", "cloud", "paris", "bzh", "alsace", "corsica",
    "ad", "ae", "ar", "at", "au", "be", "bg", "br", "ca", "ch", "ci", "cl", "cm", "cn", "co", "cy", "cz", "de", "dk",
    "dz", "ee", "eg", "es", "eu", "fi", "fr", "gf", "gp", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "io", "is",
    "it", "jp", "kr", "lt", "lu", "lv", "ma", "mc", "mg", "ml", "mq", "mt", "mx", "nc", "ng", "nl", "no", "nz", "pe",
    "pf", "ph", "pl", "pt", "re", "ro", "rs", "ru", "sa", "se", "sg", "si", "sk", "sn", "th", "tn", "tr", "tw", "ua",
    "uk", "us", "vn", "wf", "yt", "za",
]
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32_ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"

# --- First-name dictionary ---------------------------------------------------------------------------------------

FIRST_NAME_MIN_BIRTHS = 500
FIRST_NAME_EXCLUDED = ["Paris", "France"]

# --- Job stream ------------------------------------------------------------------------------------------------

JOB_MAX_TOKENS = 4096
JOB_DEFAULT_TOKENS = 512
JOB_FAILURES_ALLOWED = 2
JOB_RETRY_MIN_SECONDS = 5
JOB_RETRY_MAX_SECONDS = 30
JOB_BACKOFF_DEFAULT_SECONDS = 10.0
JOB_BACKOFF_MAX_SECONDS = 60.0
JOB_END_USER = "worker"

# --- Reports -----------------------------------------------------------------------------------------------------

REDACTED = "redacted"
BUDGET_PERIOD_DAYS = 30
