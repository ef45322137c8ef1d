"""User detectors as plug-ins: Python functions over batches of texts, held to a contract.

A detector declares its name, its entity types and its languages, and finds spans in a list of texts. It runs in Arrow
batches next to the built-in recognizers, and can neither break a query nor put a wrong span into its result: a batch that
fails is tried again text by text, a text that fails gives a row that says so, and so does a span outside of its text, of an
undeclared type or without a score from 0 to 1. All other spans stay.
"""

from __future__ import annotations

import math
import numbers
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (start, end, entity type, score); start and end count characters.
Found = tuple[int, int, str, float]
FIELDS = [
    ("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("value", pa.string(), "string"), ("entity_type", pa.string(), "string"),
    ("score", pa.float64(), "double"), ("recognizer", pa.string(), "string"), ("problem", pa.string(), "string"),
]


@dataclass(frozen=True)
class Detector:
    """find(texts) gives the spans of each text, in the order of the texts; languages None is any, also an unknown one."""

    name: str
    entity_types: tuple[str, ...]
    find: Callable[[list[str]], Sequence[Iterable[Found]]]
    languages: tuple[str, ...] | None = None
    #: Texts that find() gets at once, at most.
    batch: int = 64

    def __post_init__(self) -> None:
        if not self.name or not self.entity_types or not callable(self.find) or self.batch < 1:
            raise ValueError(f"a detector needs a name, entity types, a function and a batch of 1 or more: {self}")


class Registry:
    """Detectors by name."""

    def __init__(self) -> None:
        self._detectors: dict[str, Detector] = {}

    def add(self, detector: Detector) -> None:
        if detector.name in self._detectors:
            raise ValueError(f"there is a detector {detector.name} already")
        self._detectors[detector.name] = detector

    def remove(self, name: str) -> None:
        del self._detectors[name]

    def detectors(self, entities: Iterable[str] | None = None) -> list[Detector]:
        """All, or those that may find one of the entities."""
        wanted = None if entities is None else set(entities)
        return [d for d in self._detectors.values() if wanted is None or wanted & set(d.entity_types)]


def why_bad(span: object, text: str, types: tuple[str, ...]) -> str | None:
    """What is wrong with a span, None if nothing is."""
    if not isinstance(span, Sequence) or isinstance(span, str) or len(span) != 4:
        return "not (start, end, type, score)"
    start, end, kind, score = span
    if not all(isinstance(x, numbers.Integral) and not isinstance(x, bool) for x in (start, end)):
        return "a place is not a whole number"
    if not 0 <= start < end <= len(text):
        return "outside of the text"
    if kind not in types:
        return "undeclared type"
    if not isinstance(score, numbers.Real) or not math.isfinite(score) or not 0 <= score <= 1:
        return "no score from 0 to 1"
    return None


def _told(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def _found(detector: Detector, texts: list[str]) -> Iterator[tuple[list, str | None]]:
    """(spans, problem) of each text."""
    try:
        lists = [list(spans) for spans in detector.find(list(texts))]
        if len(lists) != len(texts):
            raise ValueError(f"{len(lists)} answers for {len(texts)} texts")
        yield from ((spans, None) for spans in lists)
    except Exception as error:  # noqa: BLE001
        if len(texts) == 1:
            yield [], _told(error)
        else:
            for text in texts:
                yield from _found(detector, [text])


def _rows(detector: Detector, texts: list[tuple[int, str]]) -> Iterator[tuple]:
    """(place of the text, *FIELDS) of some texts."""
    for (at, text), (spans, problem) in zip(texts, _found(detector, [t for _, t in texts]), strict=True):
        if problem is not None:
            yield at, None, None, None, None, None, detector.name, f"failed: {problem}"
        for span in spans:
            if (bad := why_bad(span, text, detector.entity_types)) is not None:
                yield at, None, None, None, None, None, detector.name, f"bad span: {bad}"
            else:
                start, end, kind, score = int(span[0]), int(span[1]), span[2], float(span[3])
                yield at, start, end, text[start:end], kind, score, detector.name, None


def plugin_rows(docs: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """(doc_id, start, end, value, entity_type, score, recognizer, problem) of docs (doc_id, lang, text): a row for each
    span, where problem is null, and for each text that failed and each bad span, where nothing but problem is told.

    Null texts are not shown to detectors. Texts are read once, whatever the number of detectors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    languages = None if any(d.languages is None for d in detectors) else sorted({x for d in detectors for x in d.languages})
    texts = docs.where("text IS NOT NULL").select("doc_id", "lang", "text")
    if languages is not None:
        texts = texts.where(F.col("lang").isin(languages))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs = part["lang"].to_pylist()
            for detector in detectors:
                mine = [k for k, lang in enumerate(langs) if detector.languages is None or lang in detector.languages]
                for at in range(0, len(mine), detector.batch):
                    rows = list(_rows(detector, [(k, part["text"][k].as_py()) for k in mine[at : at + detector.batch]]))
                    if rows:
                        place, *columns = zip(*rows, strict=True)
                        arrays = [pa.array(c, t) for c, (_, t, _) in zip(columns, FIELDS, strict=True)]
                        yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(place)), *arrays], names=["doc_id", *[n for n, _, _ in FIELDS]])

    return texts.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} {t}" for n, _, t in FIELDS]]))


def plugin_spans(docs: DataFrame, detectors: Sequence[Detector], entities: Iterable[str] | None = None) -> DataFrame:
    """Span rows, with the columns of `detect`; of the entities asked for."""
    found = plugin_rows(docs, detectors).where("problem IS NULL")
    if entities is not None:
        found = found.where(F.col("entity_type").isin(list(entities)))
    return found.select(
        "doc_id", "start", "end", "value", "entity_type", "score", "recognizer", F.col("score").alias("original_score"),
        F.lit(None).cast("string").alias("context_word"), F.lit(None).cast("boolean").alias("checksum"),
    )


def plugin_problems(docs: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """(doc_id, recognizer, problem): what the contract keeps out of the spans."""
    return plugin_rows(docs, detectors).where("problem IS NOT NULL").select("doc_id", "recognizer", "problem")
