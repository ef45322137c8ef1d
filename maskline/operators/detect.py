"""Detection: docs (doc_id, lang, text) -> span rows.

The pattern recognizers of a text are one projection (arrays of spans, then `inline`): the text is never shuffled.
Person names need a dictionary: runs of capitalized words are exploded and joined to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline import fixed_values as fixed
from maskline.functions import checks, patterns
from maskline.functions.text import last_words, let, matches_around_sql, matches_near_sql, matches_sql, neutral, quote, words
from maskline.operators.plugins import Detector, plugin_spans

SPAN_COLUMNS = [
    "doc_id", "start", "end", "entity_type", "score", "recognizer", "original_score", "context_word", "checksum",
]
LANGUAGES = ("fr", "en")


@dataclass(frozen=True)
class Recognizer:
    """One pattern: what it finds, its base score, its check (None when there is none), its languages and words."""

    name: str
    entity_type: str
    pattern: str
    score: float
    check: Callable[[Column], Column] | None = None
    # A failed check drops the span when `required`; a passed one gives 1.0 when `promotes`.
    promotes: bool = True
    required: bool = True
    languages: tuple[str, ...] = LANGUAGES
    context: dict[str, list[str]] = field(default_factory=dict)
    # Substring that every match holds: a cheap test before the regex.
    needs: str | None = None
    # Character just before the match that rules it out.
    not_after: str | None = None
    # Every match holds a digit: texts without any are skipped.
    digits: bool = False


def both(words: list[str]) -> dict[str, list[str]]:
    return {lang: words for lang in LANGUAGES}


NIR = Recognizer("FrNir", "FR_NIR", patterns.NIR, 0.3, checks.valid_nir, context=both(fixed.CONTEXT_NIR), digits=True)
FISCAL = Recognizer(
    "FrFiscalNumber", "FR_FISCAL_NUMBER", patterns.FISCAL_NUMBER, 0.3, checks.valid_fiscal_number,
    context=both(fixed.CONTEXT_FISCAL), digits=True,
)
STREET = Recognizer("FrAddress", "FR_ADDRESS", patterns.STREET_ADDRESS, 0.6, context=both(fixed.CONTEXT_ADDRESS), digits=True)
POSTCODE = Recognizer("FrAddress", "FR_ADDRESS", patterns.POSTCODE_CITY, 0.3, context=both(fixed.CONTEXT_ADDRESS), digits=True)
CARD = Recognizer(
    "Card", "CREDIT_CARD", patterns.CREDIT_CARD, 0.3, checks.valid_luhn, context=both(fixed.CONTEXT_CARD), digits=True,
)
FR_PHONE = Recognizer(
    "FrPhone", "PHONE_NUMBER", patterns.FR_PHONE, 0.4, checks.valid_fr_phone, promotes=False,
    context=both(fixed.CONTEXT_PHONE_FR), digits=True,
)
INTL_PHONE = Recognizer(
    "Phone", "PHONE_NUMBER", patterns.INTERNATIONAL_PHONE, 0.4, languages=("en",), needs="+",
    context={"en": fixed.CONTEXT_PHONE_EN}, digits=True,
)
IBAN = Recognizer(
    "Iban", "IBAN_CODE", patterns.IBAN, 0.5, checks.valid_iban,
    context={"fr": fixed.CONTEXT_IBAN_FR, "en": fixed.CONTEXT_IBAN_EN}, digits=True,
)
EMAIL = Recognizer(
    "Email", "EMAIL_ADDRESS", patterns.EMAIL, 0.5, checks.known_domain, required=False, context=both(fixed.CONTEXT_EMAIL), needs="@"
)
IP = Recognizer("Ip", "IP_ADDRESS", patterns.IP, 0.6, checks.valid_ip, promotes=False, context=both(fixed.CONTEXT_IP))
URL_SCHEME = Recognizer(
    "Url", "URL", patterns.URL_WITH_SCHEME, 0.6, context=both(fixed.CONTEXT_URL), needs="://", not_after="@"
)
URL_BARE = Recognizer(
    "Url", "URL", patterns.URL_BARE, 0.5, context=both(fixed.CONTEXT_URL), needs=".", not_after="@"
)
CRYPTO = Recognizer(
    "Crypto", "CRYPTO", patterns.WALLET, 0.5, checks.valid_wallet, context=both(fixed.CONTEXT_CRYPTO)
)
DATE = Recognizer("Date", "DATE_TIME", patterns.DATE, 0.6, context=both(fixed.CONTEXT_DATE), digits=True)

PATTERN_RECOGNIZERS = [
    NIR, FISCAL, STREET, POSTCODE, CARD, FR_PHONE, INTL_PHONE, IBAN, EMAIL, IP, URL_SCHEME, URL_BARE, CRYPTO, DATE,
]


def boosted(score: Column, context_word: Column) -> Column:
    raised = F.least(F.greatest(score + fixed.CONTEXT_BOOST, F.lit(fixed.CONTEXT_MIN_SCORE)), F.lit(1.0))
    return F.when(context_word.isNull(), score).otherwise(F.round(raised, 6))


def context_word_in(near: Column, listed: Column) -> Column:
    """First listed word that is a substring of one of the words near the match; those are worked out once, not per word."""
    return let(near, lambda n: F.get(F.filter(listed, lambda w: F.exists(n, lambda s: F.contains(s, w))), F.lit(0)))


def near_words(before: Column, value: Column) -> Column:
    """The last words before a match, and its own first word, lower-cased."""
    return F.concat(last_words(F.lower(before), fixed.CONTEXT_WORDS_BEFORE), F.slice(words(F.lower(value)), 1, 1))


def sql_array(listed: list[str]) -> str:
    return f"array({', '.join(map(quote, listed))})" if listed else "cast(array() as array<string>)"


def _matches_of(recognizers: list[Recognizer]) -> str:
    """One array with the raw matches of every recognizer that applies to the text's language."""
    arrays = []
    for i, r in enumerate(recognizers):
        applies = f"lang IN ({', '.join(map(quote, r.languages))})"
        if r.digits:
            applies += " AND digits"
        if r.needs:
            applies += f" AND contains(text, {quote(r.needs)})"
        arrays.append(f"IF({applies}, {matches_near_sql('text', r.pattern, i, fixed.CONTEXT_WORDS_BEFORE)}, array())")
    return f"concat({', '.join(arrays)})"


def _listed_words(recognizers: list[Recognizer]) -> Column:
    """Context words of a match, by recognizer and language of the text."""
    cases = [
        f"WHEN id = {i} AND lang = {quote(lang)} THEN {sql_array(listed)}"
        for i, r in enumerate(recognizers)
        for lang, listed in r.context.items()
    ]
    return F.expr(f"CASE {' '.join(cases)} ELSE {sql_array([])} END") if cases else F.expr(sql_array([]))


def _by_recognizer(recognizers: list[Recognizer], value: Callable[[Recognizer], Column]) -> Column:
    chosen = F.when(F.col("id") == 0, value(recognizers[0]))
    for i, r in enumerate(recognizers[1:], 1):
        chosen = chosen.when(F.col("id") == i, value(r))
    return chosen


def detect(docs: DataFrame, recognizers: list[Recognizer]) -> DataFrame:
    """Span rows of the given pattern recognizers; keeps `value`, the text of the span.

    Per text: one regex pass per recognizer, in one projection. Per match, after `inline`: checks, then context words.
    """
    languages = sorted({lang for r in recognizers for lang in r.languages})
    texts = docs.where(F.col("lang").isin(languages)).select(
        "doc_id", "lang", neutral(F.col("text")).alias("text"), F.col("text").rlike("[0-9]").alias("digits")
    )
    raw = texts.select("doc_id", "lang", F.inline(F.expr(_matches_of(recognizers))))
    # Matches that fail a required check are dropped.
    checked = [(i, r) for i, r in enumerate(recognizers) if (r.check and r.required) or r.not_after]
    if checked:
        kept = F.lit(None).cast("boolean")
        for i, r in checked:
            rule = r.check(F.col("value")) if r.check and r.required else ~F.endswith("prev", F.lit(r.not_after))
            kept = F.when(F.col("id") == i, rule).otherwise(kept)
        raw = raw.where(F.coalesce(kept, ~F.col("id").isin(*[i for i, _ in checked])))
    near = F.concat("near", F.slice(words(F.lower("value")), 1, 1))
    found = raw.withColumn("context_word", context_word_in(near, _listed_words(recognizers)))
    passed = _by_recognizer(recognizers, _passed)
    original = _by_recognizer(recognizers, lambda r: F.lit(r.score))
    return found.select(
        "doc_id", "start", "end", "value",
        _by_recognizer(recognizers, lambda r: F.lit(r.entity_type)).alias("entity_type"),
        boosted(F.when(passed, F.lit(1.0)).otherwise(original), F.col("context_word")).alias("score"),
        _by_recognizer(recognizers, lambda r: F.lit(r.name)).alias("recognizer"),
        original.alias("original_score"),
        "context_word",
        passed.alias("checksum"),
    )


def _passed(r: Recognizer) -> Column:
    """True where a check raises the score; what fails a required one is no longer there. Null where none does."""
    if r.check and r.promotes and not r.required:
        return F.when(r.check(F.col("value")), F.lit(True))
    return F.lit(True if r.check and r.promotes else None).cast("boolean")


def find_spans(docs: DataFrame, pattern: str, entity_type: str, score: float, name: str = "custom") -> DataFrame:
    """All matches of one pattern, without check or context: the building block as an operator."""
    texts = docs.select("doc_id", neutral(F.col("text")).alias("text"))
    found = texts.select("doc_id", F.inline(F.expr(matches_sql("text", pattern))))
    return found.select(
        "doc_id", "start", "end", F.lit(entity_type).alias("entity_type"), F.lit(score).alias("score"),
        F.lit(name).alias("recognizer"), "value",
    )


def detect_fr_nir(docs: DataFrame) -> DataFrame:
    return detect(docs, [NIR])


def detect_fr_fiscal_number(docs: DataFrame) -> DataFrame:
    return detect(docs, [FISCAL])


def detect_fr_address(docs: DataFrame) -> DataFrame:
    return detect(docs, [STREET])


def detect_fr_postcode_city(docs: DataFrame) -> DataFrame:
    return detect(docs, [POSTCODE])


def detect_credit_card(docs: DataFrame) -> DataFrame:
    return detect(docs, [CARD])


def detect_fr_phone(docs: DataFrame) -> DataFrame:
    return detect(docs, [FR_PHONE])


def detect_intl_phone(docs: DataFrame) -> DataFrame:
    return detect(docs, [INTL_PHONE])


def detect_iban(docs: DataFrame) -> DataFrame:
    return detect(docs, [IBAN])


def detect_email(docs: DataFrame) -> DataFrame:
    return detect(docs, [EMAIL])


def detect_ip(docs: DataFrame) -> DataFrame:
    return detect(docs, [IP])


def detect_url_outside_email(docs: DataFrame) -> DataFrame:
    """URLs with a scheme, and bare domains that are not part of one or of an e-mail address."""
    return detect(docs, [URL_SCHEME, URL_BARE])


def detect_crypto(docs: DataFrame) -> DataFrame:
    return detect(docs, [CRYPTO])


def detect_date_time(docs: DataFrame) -> DataFrame:
    return detect(docs, [DATE])


# --- Person names --------------------------------------------------------------------------------------------------


def name_runs(docs: DataFrame) -> DataFrame:
    """Runs of capitalized words of the French texts, and what their surroundings say of them."""
    texts = docs.where(F.col("lang") == "fr").select("doc_id", neutral(F.col("text")).alias("text"))
    runs = texts.select(
        "doc_id", F.inline(F.expr(matches_around_sql("text", patterns.NAME_RUN, fixed.CONTEXT_WORDS_BEFORE)))
    )
    fields = "|".join(sorted(fixed.PERSON_FIELDS, key=len, reverse=True))
    titles = "|".join(fixed.PERSON_TITLES)
    prev = F.right("before", F.lit(40))
    # `before` is lower-cased; the capital of "M." shows in the gap.
    titled_before = (F.endswith("gap", F.lit("M. ")) & prev.rlike(r"(?U)(?<![\w.])m\. $")) | (
        F.rtrim("gap").endswith(":") & prev.rlike(rf"(?U)\b(?:{fields}) ?: ?$")
    )
    titled_inside = F.col("value").rlike(rf"(?:^| |de la|de|du|des|d['’])(?:{titles})(?: |$)")
    return runs.select(
        "doc_id",
        F.col("start").alias("run_start"),
        "end",
        F.col("value").alias("run_value"),
        # What the text around a run decides is decided here: later steps carry a few words, not the text.
        last_words(F.col("before"), fixed.CONTEXT_WORDS_BEFORE).alias("words_before"),
        _alone().alias("alone_on_line"),
        (titled_before | titled_inside).alias("titled"),
    )


def _alone() -> Column:
    """The line holds nothing but the run: its gaps, up to the line ends, hold only characters that are trimmed."""
    edge = F.lit(" ,.;!")
    before = (F.col("first") | F.contains("gap", F.lit("\n"))) & (F.trim(F.substring_index("gap", "\n", -1), edge) == "")
    after = (F.col("last") | F.contains("after", F.lit("\n"))) & (F.trim(F.substring_index("after", "\n", 1), edge) == "")
    return before & after


def with_words(runs: DataFrame) -> DataFrame:
    """Adds the words of each run and the index (from 0) of its last title, -1 without one."""
    split = runs.withColumn("words", F.expr(matches_sql("run_value", patterns.NAME_WORD)))
    is_title = F.transform("words", lambda w: w["value"].isin(fixed.PERSON_TITLES))
    last_title = F.size("words") - F.nullif(F.array_position(F.reverse(is_title), True), F.lit(0))
    return split.withColumn("last_title", F.coalesce(last_title, F.lit(-1)).cast("int"))


def _names_from(runs: DataFrame) -> DataFrame:
    """Span rows of the names that start at word `name_at` of their run."""
    first = F.col("name_at")
    word_start = F.get(F.col("words"), first)["start"]
    named = runs.where(first < F.size("words")).select(
        "doc_id",
        (F.col("run_start") + word_start).alias("start"),
        "end",
        F.substring(F.col("run_value"), word_start + 1, F.length("run_value")).alias("value"),
        (F.size("words") - first).alias("n_words"),
        "titled",
        (F.col("alone_on_line") & (first == 0)).alias("alone"),
        # Words before the name: those before the run, then those of the run before the name.
        F.concat(
            F.col("words_before"),
            words(F.lower(F.substring(F.col("run_value"), F.lit(1), word_start))),
        ).alias("before"),
    )
    n = fixed.CONTEXT_WORDS_BEFORE
    near = F.concat(
        F.when(F.size("before") > n, F.slice("before", -n, n)).otherwise(F.col("before")),
        F.slice(words(F.lower("value")), 1, 1),
    )
    rule = (
        F.when(F.col("titled"), "titled").when(F.col("alone"), "on_line").when(F.col("n_words") > 1, "named")
        .otherwise("first_name")
    )
    ruled = named.select("doc_id", "start", "end", "value", rule.alias("rule"), near.alias("near"))
    scored = ruled.select(
        "doc_id", "start", "end", "value", "rule",
        F.when(F.col("rule").isin("titled", "on_line"), fixed.NAME_SCORE_STRONG)
        .when(F.col("rule") == "named", fixed.NAME_SCORE_FULL)
        .otherwise(fixed.NAME_SCORE_FIRST_ALONE).alias("original_score"),
        context_word_in(F.col("near"), F.expr(sql_array(fixed.CONTEXT_PERSON))).alias("context_word"),
    )
    told = scored.select(
        "doc_id", "start", "end", "value",
        F.lit("PERSON").alias("entity_type"),
        boosted(F.col("original_score"), F.col("context_word")).alias("score"),
        F.lit("FrPerson").alias("recognizer"),
        "original_score", "context_word",
        F.lit(None).cast("boolean").alias("checksum"),
        "rule",
    )
    # A filter on the score would be pushed below all of this, with its expressions written out, and work everything out
    # again and again; it does not go below a generator.
    return told.select(F.inline(F.array(F.struct(*told.columns))))


def titled_names(runs: DataFrame) -> DataFrame:
    """Names after a title (the last one of the run) or a form field: no dictionary needed."""
    titled = with_words(runs.where("titled"))
    return _names_from(titled.withColumn("name_at", F.col("last_title") + 1))


def known_names(runs: DataFrame, first_names: DataFrame) -> DataFrame:
    """Titled names, and names that start at the first known first name of a run without title."""
    # One short row per distinct word, in order of first occurrence; titled runs need none.
    distinct = F.array_distinct(F.regexp_extract_all("run_value", F.lit(f"({patterns.NAME_WORD})"), F.lit(0)))
    looked_up = F.when(F.col("titled"), F.array(F.lit(None).cast("string"))).otherwise(distinct)
    dictionary = first_names.select(F.col("name").alias("known")).distinct()
    hits = (
        runs.select("*", F.posexplode(looked_up).alias("nth", "word"))
        .join(dictionary, F.col("word") == F.col("known"), "left")
        .where(F.col("titled") | F.col("known").isNotNull())
    )
    # Few and short rows are left. One row per run, with its first known name.
    carried = [c for c in runs.columns if c not in ("doc_id", "run_start")]
    first = hits.groupBy("doc_id", "run_start").agg(
        F.min(F.struct("nth", "word", *carried)).alias("first")
    ).select("doc_id", "run_start", "first.*")
    split = with_words(first)
    at = F.when(F.col("titled"), F.col("last_title") + 1).otherwise(F.array_position(F.col("words.value"), F.col("word")) - 1)
    return _names_from(split.withColumn("name_at", at.cast("int")))


def detect_person(docs: DataFrame, first_names: DataFrame) -> DataFrame:
    return known_names(name_runs(docs), first_names)


def detect_person_titled(docs: DataFrame) -> DataFrame:
    return titled_names(name_runs(docs)).drop("rule")


def detect_person_on_line(docs: DataFrame, first_names: DataFrame) -> DataFrame:
    return detect_person(docs, first_names).where("rule = 'on_line'").drop("rule")


def detect_person_named(docs: DataFrame, first_names: DataFrame) -> DataFrame:
    """Known first name with other words (0.6) or alone (0.3), not alone on its line."""
    return detect_person(docs, first_names).where("rule in ('named', 'first_name')").drop("rule")


# --- All together ----------------------------------------------------------------------------------------------------


def detect_all(
    docs: DataFrame,
    first_names: DataFrame | None = None,
    entities: list[str] | None = None,
    recognizers: list[Recognizer] | None = None,
    plugins: Sequence[Detector] = (),
) -> DataFrame:
    """Every recognizer valid for the language of each text, and the user's detectors. Unused ones are not even planned."""
    chosen = [r for r in (recognizers or PATTERN_RECOGNIZERS) if entities is None or r.entity_type in entities]
    found = detect(docs, chosen) if chosen else None
    if first_names is not None and (entities is None or "PERSON" in entities):
        people = detect_person(docs, first_names).drop("rule")
        found = people if found is None else found.unionByName(people)
    chosen = [d for d in plugins if entities is None or set(entities) & set(d.entity_types)]
    if chosen:
        own = plugin_spans(docs, chosen, entities)
        found = own if found is None else found.unionByName(own)
    return found


def map_entity_labels(model_spans: DataFrame) -> DataFrame:
    """Spans (label, score, ...) of an outside model -> entity types; ignored labels dropped, weak ones scaled."""
    label = F.col("label")
    mapped = F.create_map(*[F.lit(x) for pair in fixed.MODEL_LABELS.items() for x in pair])[label]
    kept = model_spans.withColumn("entity_type", F.coalesce(mapped, label)).where(
        ~F.col("entity_type").isin(fixed.IGNORED_LABELS) & ~label.isin(fixed.IGNORED_LABELS)
    )
    scaled = F.when(label.isin(fixed.LOW_CONFIDENCE_LABELS), F.col("score") * fixed.LOW_CONFIDENCE_FACTOR)
    return kept.withColumn("score", scaled.otherwise(F.col("score"))).drop("label")


def explain_spans(spans: DataFrame) -> DataFrame:
    """Span text, recognizer, original score, context word and check result, score rounded to two digits."""
    return spans.select(
        "doc_id", F.col("entity_type").alias("type"), "start", "end", F.col("value").alias("text"),
        F.round("score", 2).alias("score"), "recognizer", "original_score", "context_word", "checksum",
    )
