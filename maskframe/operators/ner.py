"""Named-entity masking: Python finds the spans, the JVM makes the replacements."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.context import MaskContext, MaskError
from maskframe.functions.providers import get_provider
from maskframe.functions.seeds import Seed, seed_hex

Span = tuple[int, int, str]
# Called once per worker; returns a function from texts to their (start, end, label) spans.
SpanFinder = Callable[[], Callable[[list[str]], Iterable[list[Span]]]]

# Entity label to the provider of its replacement.
ENTITY_PROVIDERS = {"PERSON": "full_name", "ORG": "company", "GPE": "city", "LOC": "city"}

_SEGMENTS = "array<struct<before:string,label:string,entity:string>>"


def model_finder() -> Callable[[list[str]], Iterable[list[Span]]]:
    """spaCy's small English model; a worker that lacks it fails rather than let names through."""
    import spacy

    model = spacy.load("en_core_web_sm")

    def find(texts: list[str]) -> Iterable[list[Span]]:
        for doc in model.pipe(texts, batch_size=64):
            yield [(e.start_char, e.end_char, e.label_) for e in doc.ents]

    return find


def installed_finder() -> SpanFinder:
    """:func:`model_finder` where the model is installed; an error while the plan is built elsewhere."""
    if find_spec("spacy") is None or find_spec("en_core_web_sm") is None:
        raise MaskError("entity masking needs a span finder, or spaCy with its model en_core_web_sm")
    return model_finder


def phrase_finder(phrases: dict[str, str]) -> SpanFinder:
    """A finder for known phrases (text to label): leftmost match, longest phrase first."""

    def load() -> Callable[[list[str]], Iterable[list[Span]]]:
        import re

        ordered = sorted(phrases, key=len, reverse=True)
        pattern = re.compile("|".join(map(re.escape, ordered)))

        def find(texts: list[str]) -> Iterable[list[Span]]:
            for text in texts:
                yield [(m.start(), m.end(), phrases[m.group()]) for m in pattern.finditer(text)]

        return find

    return load


def pattern_finder(patterns: dict[str, str]) -> SpanFinder:
    """A finder for regular expressions, label to pattern; earlier labels win on overlap."""

    def load() -> Callable[[list[str]], Iterable[list[Span]]]:
        import re

        parts = [f"(?P<{label}>{pattern})" for label, pattern in patterns.items()]
        combined = re.compile("|".join(parts))

        def find(texts: list[str]) -> Iterable[list[Span]]:
            for text in texts:
                yield [(m.start(), m.end(), m.lastgroup) for m in combined.finditer(text)]

        return find

    return load


def segments_of(text: Column, entities: Iterable[str], finder: SpanFinder) -> Column:
    """Split each text at its entities; the last segment holds the tail and no entity."""
    wanted = frozenset(entities) & frozenset(ENTITY_PROVIDERS)

    def split(value: str, spans: list[Span]) -> list[dict[str, str | None]]:
        out, cursor = [], 0
        for start, end, label in spans:
            if label not in wanted:
                continue
            entity = unicodedata.normalize("NFC", value[start:end])
            out.append({"before": value[cursor:start], "label": label, "entity": entity})
            cursor = end
        out.append({"before": value[cursor:], "label": None, "entity": None})
        return out

    @F.pandas_udf(_SEGMENTS)
    def segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder()
        for batch in batches:
            present = batch[batch.notna() & (batch != "")]
            spans = find(list(present))
            found = {
                i: split(v, s) for (i, v), s in zip(present.items(), spans, strict=True)
            }
            yield pd.Series([found.get(i) for i in batch.index], index=batch.index, dtype=object)

    return segments(text)


def join_segments(segments: Column, ctx: MaskContext, path: str) -> Column:
    """Put the text back together with each entity replaced by its label's fake."""

    def fake(label: Column, entity: Column) -> Column:
        out = None
        for name, provider in ENTITY_PROVIDERS.items():
            seed = Seed(seed_hex(entity, ctx.salt, f"{path}#ner:{name}"))
            value = get_provider(provider).fn(seed, entity, {}, ctx)
            out = F.when(label == name, value) if out is None else out.when(label == name, value)
        return out

    pieces = F.transform(
        segments,
        lambda s: F.concat(
            s["before"], F.coalesce(F.when(s["entity"] != "", fake(s["label"], s["entity"])), F.lit(""))
        ),
    )
    return F.array_join(pieces, "")
