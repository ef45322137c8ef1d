"""The regular expressions of the recognizers, which results depend on, as plain text.

Built from the fixed word lists and registries.

Java syntax. Loops over whole words are possessive: nothing after them can need a shorter run, and Java then loops
instead of recursing, so a text made of one endless run cannot overflow the stack.
"""

from maskline.fixed_values import (
    CALLING_CODES,
    CITY_LINKS,
    IBAN_COUNTRIES,
    STREET_LINKS,
    STREET_TYPES,
    TOP_LEVEL_DOMAINS,
)
from maskline.functions.text import FLAGS


def any_of(items) -> str:
    return "(?:" + "|".join(items) + ")"


def literal(word: str) -> str:
    return word.replace(".", r"\.")


def flagged(pattern: str) -> str:
    return FLAGS + pattern


NIR = flagged(r"\b[1-478] ?[0-9]{2} ?(?:0[1-9]|1[0-2]|[23][0-9]|4[0-2]|[5-9][0-9]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b")

FISCAL_NUMBER = flagged(r"\b[0-3][0-9] ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b")

# First four digits 1, 3, 4 and 6, 50 to 55, 2221 to 2720.
CREDIT_CARD = flagged(
    r"\b(?!1[0-9]{12}(?![0-9]))(?:[1346][0-9]{3}|5[0-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)(?:[- ]?[0-9]{3,4}){2}[- ]?[0-9]{3,5}\b"
)

IBAN = flagged(
    r"(?<!\w)(?=[A-Z]{2}[ -]?[0-9]{2})"
    + any_of(
        f"{any_of(countries)}[ -]?[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{length - 4}}}"
        for length, countries in sorted(IBAN_COUNTRIES.items(), reverse=True)
    )
    + r"(?!\w)"
)

_LABEL = "[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?"
# Labels that more of the name follows: another label and its dot, or the last label. Java loops over a possessive group
# and recurses over others, so that the loop must know by itself where to stop.
_LABELS = rf"(?:{_LABEL}\.(?=[A-Z0-9][A-Z0-9-]*\.[A-Z0-9]|[A-Z]{{2,24}}(?![\w-])))++"
EMAIL = flagged(rf"(?<![\w.%+-])[A-Z0-9_][A-Z0-9._%+-]*+@{_LABELS}[A-Z]{{2,24}}(?![\w-])")

IP = flagged(r"(?<![\w.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])|(?=:*[0-9a-f])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![\w:]))")

_TOP = any_of(TOP_LEVEL_DOMAINS)
_HOST = rf"(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\.(?=[A-Z0-9][A-Z0-9-]*\.[A-Z0-9]|{_TOP}(?![\w-])))++{_TOP}"
_PATH = r"(?::[0-9]{1,5})?(?:[/?#](?:[^\s<>\"'()\[\]{}]*[\w/=&#-])?)?"
URL_WITH_SCHEME = flagged(rf"\bhttps?://{_HOST}\b{_PATH}")
URL_BARE = flagged(rf"(?<![\w./:@-]){_HOST}(?![\w@-]|\.\w){_PATH}")

WALLET = "(?Us)" + r"(?<!\w)(?:bc1[ac-hj-np-z02-9]{11,71}|BC1[AC-HJ-NP-Z02-9]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34})(?!\w)"

DATE = flagged(
    r"(?<![\w/.-])"
    + any_of([
        r"[0-9]{4}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])",
        r"(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|1[0-2])\2(?:[0-9]{4}|[0-9]{2})",
        r"(?:0?[1-9]|1[0-2])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\3(?:[0-9]{4}|[0-9]{2})",
    ])
    + r"(?![\w/-]|\.[0-9])"
)

# Nine national digits after 0, +33 or 0033, with at most one separator between two digits.
FR_PHONE = flagged(r"(?<![\w+])(?<![0-9][ .,-])(?:(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?|0)[1-9](?:[ .-]?[0-9]){8}(?![\w]|[ .-][0-9])")

_GAP = r"[ ().-]{0,2}"


def _international(code: str, bounds: tuple[int, int]) -> str:
    if code == "1":  # North America: area code and exchange start with 2 to 9
        return rf"1{_GAP}[2-9](?:{_GAP}[0-9]){{2}}{_GAP}[2-9](?:{_GAP}[0-9]){{6}}"
    low, high = bounds
    return rf"{code}(?:{_GAP}[0-9]){{{low},{high}}}"


INTERNATIONAL_PHONE = flagged(
    r"(?<![\w+])\+" + any_of(_international(c, b) for c, b in CALLING_CODES.items()) + r"(?![\w])"
)

# --- French addresses: words that must be capitalized switch IGNORECASE off ------------------------------------------

_WORD = r"(?-i:[A-ZÀ-ÖØ-Þ0-9][\w'’-]*+)"
_STREET_NAME = (
    rf"(?:{any_of(STREET_LINKS)} ?)?{_WORD}"
    rf"(?: (?:{any_of(STREET_LINKS)} ?)?{_WORD})*+"
)
_STREET = rf"[0-9]{{1,4}}(?: ?(?:bis|ter|quater|[a-d])\b)?,? ?{any_of(map(literal, STREET_TYPES))}(?![\w-]) {_STREET_NAME}"
_POSTCODE = any_of(["0[1-9]", "[1-8][0-9]", "9[0-5]", "97", "98"]) + "[0-9]{3}"
_CITY = rf"{_WORD}(?:[ -](?:{any_of(CITY_LINKS)}[ -])?{_WORD})*+(?: cedex(?: [0-9]{{1,2}})?)?"

POSTCODE_CITY = flagged(rf"\b{_POSTCODE} {_CITY}")
STREET_ADDRESS = flagged(rf"\b{_STREET}(?:,? ?\n?{_POSTCODE} {_CITY})?")

# --- French names: case matters ------------------------------------------------------------------------------------

_NAME = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þa-zà-öø-ÿ][a-zà-öø-ÿ]+)*+"
NAME_WORD = f"(?U){_NAME}"
NAME_RUN = rf"(?U)(?<![\w'’-]){_NAME}(?: (?:(?:de la|de|du|des|d['’]) ?)?{_NAME})*+"
TITLE_BEFORE = r"(?U)(?<![\w.])M\. $"
ANSWER_MARKER = "<[A-Z_]+_[0-9]+>"
