"""A registry of sources: what to read from the pages of each, declared, and one plan for all of them.

A source names the kind of its pages, where records are in them, the fields of a record and, as Columns
over these fields, the columns of a staged event. Pages of all sources go through one Arrow reader,
which only finds records and hands them on as JSON; everything else is Columns over VARIANT,
chosen by the source's name. What cannot be read is a row with an error, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.payloads import WARMUP_SCRIPT, embedded_events, text_at
from marquee.sources import elements, pages

#: Columns of a staged event.
STAGED = {
    "title": "string", "subtitle": "string", "description": "string", "event_type": "string", "event_date": "date", "doors_time": "string", "start_time": "string", "image_url": "string",
    "source_url": "string", "source_id": "string", "ticket_url": "string", "genre": "string", "price_presale": "decimal(10,2)", "price_box_office": "decimal(10,2)", "price_note": "string",
    "sold_out": "boolean", "free": "boolean", "status": "string",
}
#: What a staged event must have.
REQUIRED = ("title", "event_date", "source_id")

#: Values of a record by the name of the field; "" is the record itself (VARIANT), "url" its page's address.
Fields = Callable[[str], Column]


@dataclass(frozen=True)
class Source:
    """name: what pages call it. kind: one of READERS. rows: where records are: a selector for elements, a
    type for json_ld, a list's name for script, a path to a list for api, nothing for warmup. fields:
    for elements selector and value (see elements.value), for the others paths from the record.
    columns: the staged columns, from the fields; fields of a column's name stand for themselves."""

    name: str
    kind: str
    rows: str
    fields: Mapping[str, tuple[str, str] | str]
    columns: Mapping[str, Callable[[Fields], Column]] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in READERS:
            raise ValueError(f"no kind of page: {self.kind}")
        if unknown := set(self.columns) - set(STAGED):
            raise ValueError(f"no staged columns: {sorted(unknown)}")
        for f in self.fields.values():
            if (self.kind == "elements") is isinstance(f, str):
                raise ValueError("fields are selectors with values for elements, paths for all others")
        if self.kind == "elements":
            for text in [self.rows, *(s for s, _ in self.fields.values())]:
                if text:
                    elements.compiled(text)


def _of_elements(page: str, source: Source) -> list:
    root = elements.parse(page)
    return [{n: elements.value(e, *f) for n, f in source.fields.items()} for e in (root.select(source.rows) if source.rows else [root])]


def _of_json_ld(page: str, source: Source) -> list:
    return pages.json_ld(page, source.rows or "Event")


def _of_script(page: str, source: Source) -> list:
    for e in elements.parse(page).select("script"):
        found = elements.member_list("".join(c for c in e.children if isinstance(c, str)), source.rows)
        if found is not None:
            return found
    raise ValueError(f"no script has a list {source.rows}")


def _of_warmup(page: str, source: Source) -> list:
    """The embedded state as it stands: its events are found by Columns."""
    e = elements.parse(page).first(WARMUP_SCRIPT)
    if e is None:
        raise ValueError("no embedded state")
    return ["".join(c for c in e.children if isinstance(c, str))]


def _of_api(page: str, source: Source) -> list:
    """A list in a JSON answer, by names and dots; an empty path is the answer."""
    found = json.loads(page)
    for name in source.rows.split(".") if source.rows else []:
        found = found.get(name) if isinstance(found, dict) else None
    if not isinstance(found, list):
        raise ValueError(f"no list at {source.rows or 'the top'}")
    return found


#: Kinds of pages, and what finds the records in one: a list of values, or ValueError.
READERS: dict[str, Callable[[str, Source], list]] = {"elements": _of_elements, "json_ld": _of_json_ld, "script": _of_script, "warmup": _of_warmup, "api": _of_api}


class Registry:
    """Sources by name; a name stands once."""

    def __init__(self, *sources: Source):
        self.sources = {s.name: s for s in sources}
        if len(self.sources) < len(sources):
            raise ValueError("a name stands twice")

    def records(self, of: DataFrame, source: str = "source", url: str = "url", page: str = "page") -> DataFrame:
        """(source, url, pos, record, error): a row for each record of the pages, numbered from 1, as VARIANT. A
        page that cannot be read, whose source is unknown or null, or without text has one row, at
        place 0, with the error; a page without records has none."""
        known = self.sources

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for name, address, text in zip(b["s"], b["u"], b["p"], strict=True):
                    try:
                        if name not in known:
                            raise ValueError("unknown source")
                        if text is None:
                            raise ValueError("no page")
                        reader = known[name]
                        raw = reader.kind == "warmup"
                        found = READERS[reader.kind](text, reader)
                        out += [(name, address, i, x if raw else json.dumps(x, ensure_ascii=False), None) for i, x in enumerate(found, 1)]
                    except ValueError as e:
                        out.append((name, address, 0, None, str(e)))
                yield pd.DataFrame(out, columns=["source", "url", "pos", "record", "error"])

        found = of.select(F.col(source).alias("s"), F.col(url).alias("u"), F.col(page).alias("p")).mapInPandas(run, "source string, url string, pos int, record string, error string")
        warm = [s.name for s in self.sources.values() if s.kind == "warmup"]
        if not warm:
            return self._parsed(found)
        # one plan for both, so that pages are read once
        record, none = F.try_parse_json("record"), F.try_parse_json(F.lit(None).cast("string"))
        state = F.coalesce(F.col("source").isin(warm) & F.col("error").isNull(), F.lit(False))
        read = found.select("source", "url", "pos", state.alias("state"), F.when(state, embedded_events(F.col("record"))).alias("events"), F.when(~state, record).alias("parsed"), (~state & F.col("record").isNotNull()).alias("given"), "error")

        def row(pos: Column, value: Column, error: Column) -> Column:
            return F.struct(pos.cast("int").alias("pos"), value.alias("record"), error.cast("string").alias("error"))

        lost = F.when(F.col("given") & F.col("parsed").isNull(), "no JSON")
        rows = (
            F.when(~F.col("state"), F.array(row(F.col("pos"), F.col("parsed"), F.coalesce("error", lost))))
            .when(F.col("events").isNull(), F.array(row(F.lit(0), none, F.lit("no list of events in the embedded state"))))
            .otherwise(F.transform("events", lambda e, i: row(i + 1, e, F.lit(None))))
        )
        return read.select("source", "url", F.explode(rows).alias("r")).select("source", "url", "r.pos", "r.record", "r.error")

    @staticmethod
    def _parsed(found: DataFrame) -> DataFrame:
        record = F.try_parse_json("record")
        lost = F.when(F.col("record").isNotNull() & record.isNull(), "no JSON")
        return found.select("source", "url", "pos", record.alias("record"), F.coalesce("error", lost).alias("error"))

    def staged(self, of: DataFrame, **names: str) -> DataFrame:
        """(source, url, pos, *STAGED, error): the records as staged events. error also names the first of
        REQUIRED that a record lacks."""
        found = self.records(of, **names)

        def column(name: str) -> Column:
            out = None
            for s in self.sources.values():
                made = self._made(s, name)
                if made is not None:
                    out = F.when(F.col("source") == s.name, made) if out is None else out.when(F.col("source") == s.name, made)
            out = F.lit(None) if out is None else out
            return F.when(F.col("pos") > 0, out).cast(STAGED[name]).alias(name)

        rows = found.select("source", "url", "pos", *map(column, STAGED), "error")
        lacks = F.coalesce(*[F.when(F.col(c).isNull(), f"no {c}") for c in REQUIRED])
        return rows.withColumn("error", F.coalesce("error", lacks))

    @staticmethod
    def _made(source: Source, name: str) -> Column | None:
        def get(field_name: str) -> Column:
            if field_name == "":
                return F.col("record")
            if field_name == "url":
                return F.col("url")
            path = f"$['{field_name}']" if source.kind == "elements" else source.fields[field_name]
            return text_at(F.col("record"), path)

        if name in source.columns:
            return source.columns[name](get)
        return get(name) if name in source.fields else None
