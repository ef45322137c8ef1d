"""Positions of regex matches as native expressions, in code points.

Every match is wrapped in two control characters, the text is split on the first one, and the pieces give positions
by their lengths. One regex pass per pattern, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, NEUTRAL = "\u0001", "\u0002", "\u0003"
# Unicode classes, case-insensitive, multi-line, dot matches line ends.
FLAGS = "(?Uims)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def neutral(text: Column) -> Column:
    """The text with our two control characters replaced: same length, still neither word nor space characters."""
    dirty = text.contains(OPEN) | text.contains(CLOSE)
    return F.when(dirty, F.translate(text, OPEN + CLOSE, NEUTRAL + NEUTRAL)).otherwise(text)


def quote(value: str) -> str:
    """value as a SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


# The expressions below are SQL text: one parse in the JVM instead of thousands of calls from Python. `p` is the array
# of pieces: the text before the first match, then for each match its value, CLOSE, and the gap after it.


def _pieces_by(text: str, pattern: str) -> str:
    return f"split(regexp_replace({text}, {pattern}, '\\u0001$0\\u0002'), '\\u0001')"


def _pieces(text: str, pattern: str) -> str:
    return _pieces_by(text, quote(pattern))


# Starts of the matches: running sums of the piece lengths. Appending to one array would copy it for every match, so
# the sums run over about sqrt(n) blocks first, then inside each block: n * sqrt(n) small copies, not n * n.
_RUNNING = """aggregate({items}, struct({first} AS pos, cast(array() AS array<int>) AS starts),
  (acc, x) -> struct(acc.pos + {step} AS pos, array_append(acc.starts, acc.pos) AS starts), acc -> acc.starts)"""
_STARTS = f"""transform(array(transform(slice(p, 2, size(p) - 1), x -> length(x) - 1)), q ->
  transform(array(cast(ceil(sqrt(size(q))) AS int)), b ->
    transform(array(transform(sequence(0, cast(ceil(size(q) / b) AS int) - 1), k -> slice(q, k * b + 1, b))), blocks ->
      transform(array({_RUNNING.format(items='blocks', first='length(p[0])', step='aggregate(x, 0, (t, n) -> t + n)')}), firsts ->
        flatten(transform(blocks, (block, k) -> {_RUNNING.format(items='block', first='get(firsts, k)', step='x')})))[0])[0])[0])[0]"""


def matches_sql(text: str, pattern: str) -> str:
    """array<struct<start:int, end:int, value:string>> of all non-overlapping matches, half-open offsets.

    `text` must be free of the two control characters: see neutral().
    """
    return matches_by_sql(text, quote(pattern))


def matches_by_sql(text: str, pattern: str) -> str:
    """Same, the pattern being an expression."""
    return f"""transform(array({_pieces_by(text, pattern)}), p -> IF(size(p) = 1, array(), transform({_STARTS}, (s, i) ->
      transform(array(substring_index(get(p, i + 1), '\\u0002', 1)), v ->
        struct(s AS start, s + length(v) AS `end`, v AS value))[0])))[0]"""


def _before(back: int) -> str:
    """The text before match i, from the pieces of the last `back` matches, lower-cased."""
    first = f"greatest(i - {back - 2}, 1)"
    return f"lower(translate(array_join(slice(p, {first}, i + 2 - {first}), ''), '\\u0002', ''))"


def matches_near_sql(text: str, pattern: str, id_: int, n_words: int) -> str:
    """Same, plus an id, the last n_words lower-cased words before each match (near), and the last character (prev).

    A match holds at least one word, so the pieces of the last n_words + 1 matches hold enough of them, or reach the
    start of the text: linear in the text, unlike a prefix per match.
    """
    found = "regexp_extract_all({}, '(?U)(\\\\w+)', 1)"
    last = f"IF(size(w) > {n_words}, slice(w, -{n_words}, {n_words}), w)"
    # More than n_words words in the tail: the last ones are whole. Otherwise the whole piece is split.
    near = f"""transform(array({found.format(f'right(b, {40 * n_words})')}), w -> IF(size(w) > {n_words}, slice(w, -{n_words}, {n_words}),
        transform(array({found.format('b')}), w -> {last})[0]))[0]"""
    return f"""transform(array({_pieces(text, pattern)}), p -> IF(size(p) = 1, array(), transform({_STARTS}, (s, i) ->
      transform(array(struct(substring_index(get(p, i + 1), '\\u0002', 1) AS v, {_before(n_words + 1)} AS b)), m ->
        struct({id_} AS id, s AS start, s + length(m.v) AS `end`, m.v AS value,
          transform(array(m.b), b -> {near})[0] AS near, right(m.b, 1) AS prev))[0])))[0]"""


def matches_around_sql(text: str, pattern: str, n_words: int) -> str:
    """Same, with the texts themselves for a later look: before (lower-cased, enough for n_words words), gap and after
    (the text up to the previous and the next match), first and last (whether those reach the ends of the text)."""
    return f"""transform(array({_pieces(text, pattern)}), p -> IF(size(p) = 1, array(), transform({_STARTS}, (s, i) ->
      transform(array(substring_index(get(p, i + 1), '\\u0002', 1)), v ->
        struct(s AS start, s + length(v) AS `end`, v AS value, {_before(n_words + 1)} AS before,
          substring_index(get(p, i), '\\u0002', -1) AS gap, substring_index(get(p, i + 1), '\\u0002', -1) AS after,
          i = 0 AS first, i + 2 = size(p) AS last))[0])))[0]"""


def words(text: Column) -> Column:
    """All words (runs of Unicode word characters)."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def last_words(before: Column, n: int) -> Column:
    """The last n words of a text."""
    return let(words(before), lambda found: F.when(F.size(found) > n, F.slice(found, -n, n)).otherwise(found))


def replace_spans_sql(text: str, spans: str, field: str, block: int = 128) -> str:
    """The text with each span (sorted, not overlapping) replaced by its `field`.

    substring() walks from the start of its text, so spans are taken in blocks: one walk over the whole text per block,
    and short ones inside the block's own part.
    """
    before = "IF(i = 0, m.o, get(m.b, i - 1).`end`)"
    return f"""IF(coalesce(size({spans}), 0) = 0, {text}, concat(
      array_join(transform(sequence(0, cast(ceil(size({spans}) / {block}) AS int) - 1), k ->
        transform(array(struct(slice({spans}, k * {block} + 1, {block}) AS b, IF(k = 0, 0, get({spans}, k * {block} - 1).`end`) AS o)), m ->
          transform(array(substring({text}, m.o + 1, get(m.b, size(m.b) - 1).`end` - m.o)), t ->
            array_join(transform(m.b, (s, i) -> concat(substring(t, {before} - m.o + 1, s.start - {before}), s.{field})), ''))[0])[0]), ''),
      substring({text}, get({spans}, size({spans}) - 1).`end` + 1, length({text}))))"""


def title_case(name: Column) -> Column:
    """Upper-case first letter of every run of letters, the rest lower: JEAN-PIERRE -> Jean-Pierre."""
    runs = F.regexp_extract_all(name, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 2**30)))), "")
