"""The search of a folder: files -> fields (from the index or the bytes) -> units -> matches -> summaries.

Extraction yields an error column rather than an exception, so one bad file never stops a task. Texts are prepared and split into
units in the workers; matching, quantifiers, exclusion and deduplication are column expressions and aggregates.

The list of files is written first and dealt by a hash of their paths, so a folder of any size is read by many tasks. Without an index one
pass over the files makes their units, and only those that have a term are kept. With a log the folders are searched in waves that
fill the cluster a few times; what a wave found is in the log before the next one starts.
"""

from __future__ import annotations

import errno
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import broken_reason, describe_unreadable, parse_when
from ..functions.nodegraph import flat_summary, is_wanted, stored_prompts, summarise, units_of
from ..functions.text import prepare
from ..sources import media, walk
from ..sources.results_log import ResultsLog
from .match import SearchSpec, distinct_targets, matches, search

#: About how many files a task opens, at least how many where there are few, and the tasks beyond which each opens more.
FILES, FEWEST, TASKS = 2000, 64, 20_000
#: How many times a wave of a logged search fills the cluster.
FILLS = 4
UNITS = "array<struct<unit_ord:int,label:string,text:string>>"
_units_type = pa.list_(pa.struct([("unit_ord", pa.int32()), ("label", pa.string()), ("text", pa.string())]))
FIELDS = "array<struct<ord:int,field:string,text:string>>"
_fields_type = pa.list_(pa.struct([("ord", pa.int32()), ("field", pa.string()), ("text", pa.string())]))
#: Fixed value: how an alias file of one desktop starts; these are links that other systems cannot follow.
ALIAS_MAGIC = b"book\0\0\0\0mark\0\0\0\0"


def error_text(x: BaseException, path: str) -> str:
    """``Kind: message``, without the path, with one name for all shortages of file handles."""
    if isinstance(x, OSError) and x.errno in (errno.EMFILE, errno.ENFILE):
        return "TooManyOpenFiles: too many open files"
    said = (x.strerror if isinstance(x, OSError) and x.strerror else str(x)).replace(repr(path), "").replace(path, "").strip(" :")
    return f"{type(x).__name__}: {said}" if said else type(x).__name__


def read_file(path: str, ext: str, deep: bool) -> tuple[list[dict] | None, str | None, bytes | None]:
    """(fields, error, head) of a file: the fields, or what went wrong and its first 64 bytes."""
    head = None
    try:
        with open(path, "rb") as f:
            try:
                return [{"ord": k, "field": n, "text": _valid(t)} for k, (n, t) in enumerate(media.fields(f, ext, deep))], None, None
            except Exception:
                f.seek(0)
                head = f.read(64)
                raise
    except Exception as x:  # an error is a value here
        return None, "AliasFile" if head is not None and head.startswith(ALIAS_MAGIC) else error_text(x, path), head


def _valid(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def extract(files: DataFrame, deep: bool = False, spec: SearchSpec | None = None, keep: bool = True) -> DataFrame:
    """``files`` with fields, error and head (the first 64 bytes of what could not be read). The column ``target`` is opened.

    With ``spec`` the units of the fields are made in the same pass, as the column u; the fields are null then unless they are to be kept.
    """
    from pyspark.sql.types import StructType

    kept = files.drop("fields", "error", "head", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = unit_maker(spec) if spec else None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found, errors, heads, made = [], [], [], []
                for path, ext in zip(part.column(part.schema.get_field_index("target")).to_pylist(), part.column(part.schema.get_field_index("ext")).to_pylist()):
                    fields, error, head = read_file(path, ext, deep)
                    made.append(split(fields) if split else None)
                    found.append(fields if keep or not split else None)
                    errors.append(error)
                    heads.append(head)
                more = {"fields": pa.array(found, _fields_type), "error": pa.array(errors, pa.string()), "head": pa.array(heads, pa.binary())}
                more |= {"u": pa.array(made, _units_type)} if split else {}
                yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])

    added = f"fields {FIELDS}, error string, head binary" + (f", u {UNITS}" if spec else "")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(added).fields]))


def spread(files: DataFrame) -> DataFrame:
    """``files`` (written, few bytes a row) dealt over tasks of about as many files each."""
    n = files.count()
    tasks = max(-(-n // FILES), min(2 * files.sparkSession.sparkContext.defaultParallelism, -(-n // FEWEST)), 1)
    return files.repartition(min(tasks, TASKS), "path")


def resolve(files: DataFrame, follow_links: bool) -> DataFrame:
    """``files`` with target (the path to open) and skipped: the kind of a link that is not followed or is dead."""
    skipped = F.when(F.col("is_link") & F.col("dead"), "dead link").when(F.col("is_link") & F.lit(not follow_links), "symlink")
    return files.withColumn("target", F.coalesce("link_target", "path")).withColumn("skipped", skipped)


def with_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with the error extended by what the file seems to hold, and alias files marked as skipped links."""
    hint = describe_unreadable(F.coalesce("head", F.lit(b"")), F.coalesce(F.col("length"), F.lit(0)))
    alias = F.col("error") == "AliasFile"
    error = F.when(F.col("error").isNotNull() & ~alias, F.when(F.col("head").isNotNull(), F.concat("error", F.lit(" ["), hint, F.lit("]"))).otherwise(F.col("error")))
    return rows.withColumn("skipped", F.coalesce("skipped", F.when(alias, "Finder alias"))).withColumn("error", error).drop("head")


def _gate(spec: SearchSpec) -> Callable[[str], bool] | None:
    """Whether a graph's raw text can match at all; decided before it is parsed.

    A term needs its longest run of plain letters and digits, however the rest of it is written in JSON. Regular expressions are the
    engine's alone, so they decide nothing here.
    """
    if spec.regex:
        return None

    def needs(term: str) -> re.Pattern:
        run = max(re.findall("[A-Za-z0-9]+", unicodedata.normalize("NFC", term)), key=len, default="")
        return re.compile(run, 0 if spec.case_sensitive else re.IGNORECASE)

    wanted, unwanted = ([needs(t) for t in ts] for ts in (spec.terms, spec.excluded))
    whole = all if spec.mode == "all" and spec.scope != "image" else any
    return lambda text: whole(r.search(text) for r in wanted) or any(r.search(text) for r in unwanted)


def unit_maker(spec: SearchSpec) -> Callable[[list[dict] | None], list[dict]]:
    """A function from the fields of a file to its units (unit_ord, label, text)."""
    names = {f.lower() for f in spec.fields}
    gate = _gate(spec) if spec.terms else None

    def split(fields: list[dict] | None) -> list[dict]:
        found: list[tuple[str, str]] = []
        given = [(f["field"], f["text"]) for f in fields or () if f["text"]]
        if spec.saved_kinds is not None:
            found = [(f"{n}:{k}", prepare(t)) for n, k, kind, t in stored_prompts(given) if is_wanted(kind, k, spec.saved_kinds) and (not names or n.lower() in names)]
        else:
            for n, t in given:
                if not names or n.lower() in names:
                    found += units_of(n, prepare(t), connected_mode=spec.connected, per_node=spec.scope == "node", node_types=spec.node_types, inputs=spec.inputs, gate=gate)
        return [{"unit_ord": k, "label": n, "text": _valid(t)} for k, (n, t) in enumerate(found)]

    return split


def units(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """(entity, unit_ord, label, text): the units of the fields of ``rows`` (path, fields)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = unit_maker(spec)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([split(f) for f in b.column(1).to_pylist()], _units_type)], names=["entity", "u"])

    return exploded(rows.select("path", "fields").mapInArrow(run, f"entity string, u {UNITS}"))


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("entity", F.explode("u").alias("u")).select("entity", "u.*")


def telling(spec: SearchSpec) -> Column:
    """The units of the column u that have a term or an excluded one: no others can matter."""

    def said(unit: Column) -> Column:
        found = F.lit(False)
        for t in (*spec.terms, *spec.excluded):
            found = found | matches(unit["text"], t, spec.regex, spec.case_sensitive)
        return found

    return F.filter("u", said)


def summaries(rows: DataFrame) -> DataFrame:
    """(path, summary, flat): the summary of the fields as JSON, null where there is none, and its one-line strings."""
    keys = ("positive", "negative", "intermediate", "models", "loras", "sampler")
    flat_type = pa.struct([(k, pa.string()) for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full, flat = [], []
            for fields in b.column(1).to_pylist():
                try:
                    s = summarise((f["field"], f["text"]) for f in fields or ())
                except Exception:  # a graph that is none must not stop a search
                    s = {}
                full.append(json.dumps(s, ensure_ascii=False).encode("utf-8", "replace").decode() if s else None)
                flat.append({k: v.encode("utf-8", "replace").decode() for k, v in flat_summary(s).items()} if s else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.string()), pa.array(flat, flat_type)], names=["path", "summary", "flat"])

    return rows.select("path", "fields").mapInArrow(run, "path string, summary string, flat struct<" + ",".join(f"{k}:string" for k in keys) + ">")


def scan(spark: SparkSession, root: str, spec: SearchSpec, *, follow_links: bool = False, show: bool = False, index: str | None = None, log: ResultsLog | None = None, skip_dirs: DataFrame | None = None, since: str | None = None, until: str | None = None, **walk_options) -> dict[str, DataFrame]:
    """Search ``root``. Returns tables: scanned (path, dir, error, skipped, cached …) and results (path, hits, original, summary …).

    With ``log`` the folders that it has as done are passed over, and those searched now are put into it wave by wave. A wave has whole
    folders. The index is saved at the end, not by wave: saving rewrites all of its parts.
    """
    from ..sources import index as store
    from ..sources.state import new_folder, written

    for key, text in (("since", since), ("until", until)):
        if text:
            walk_options[key] = parse_when(text, end_of_day=key == "until").timestamp()
    files = walk.files(spark, root, **walk_options)
    for done in ([skip_dirs] if skip_dirs is not None else []) + ([log.done()] if log else []):
        files = pending(files, done)
    rows = written(resolve(files, follow_links))
    if log is None:
        done, matched, fresh = _searched(rows, spec, follow_links, show, index)
    else:
        waves = max(1, -(-rows.count() // (FILES * FILLS * spark.sparkContext.defaultParallelism)))
        place, schemas = new_folder(spark), {}
        for k in range(waves):
            some = rows.where(F.pmod(F.xxhash64("dir"), F.lit(waves)) == k)
            parts = dict(zip(("scanned", "matched", "fresh"), _searched(some, spec, follow_links, show, index)))
            for name, t in parts.items():
                if t is not None:
                    schemas[name], parts[name] = t.schema, written(t, f"{place}/{name}/wave={k}")
            log.record({"scanned": parts["scanned"], "results": _single(parts["matched"], follow_links)})
        done, matched, fresh = (spark.read.schema(schemas[n]).parquet(f"{place}/{n}").drop("wave") if n in schemas else None for n in ("scanned", "matched", "fresh"))
    if index:
        store.save(fresh, index, spec.deep)
    return {"scanned": done, "matched": matched, "results": _single(matched, follow_links).drop("is_link")}


def _single(matched: DataFrame, follow_links: bool) -> DataFrame:
    """One result for each real file: the file itself before links to it, then by path."""
    found = distinct_targets(matched, "target", "is_link", "path") if follow_links else matched
    return found.withColumn("original", F.when(F.col("is_link"), F.col("target")))


def _searched(rows: DataFrame, spec: SearchSpec, follow_links: bool, show: bool, index: str | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(scanned, matched, what was read for the index) of a written list of files."""
    from ..sources import index as store
    from ..sources.state import written

    todo, passed = rows.where("skipped is null"), rows.where("skipped is not null")
    fresh = None
    if index:
        read, held = store.lookup(todo, store.load(rows.sparkSession, index), spec.deep)
        fresh = written(extract(spread(written(read)), spec.deep).withColumn("cached", F.lit(False)))
        found = fresh.unionByName(written(held.withColumn("cached", F.lit(True))), allowMissingColumns=True)  # before the index is rewritten
    else:
        found = extract(spread(todo), spec.deep, None if spec.broken else spec, show)
        found = found.withColumn("cached", F.lit(False)).withColumns({} if spec.broken else {"u": telling(spec)})
    done = written(with_errors(found.unionByName(passed, allowMissingColumns=True)))
    scanned = done.drop("fields", "u")
    if spec.broken:
        bad = done.where("error is not null or (skipped = 'dead link' and %s)" % ("true" if follow_links else "false"))
        return scanned, bad.select("path", "target", "is_link", F.array(F.struct(F.lit(0).alias("term"), F.lit("error").alias("label"), F.coalesce("error", F.lit("dead link")).alias("snippet"))).alias("hits")), fresh
    good = done.where("error is null and skipped is null")
    made = units(good, spec) if index else exploded(good.select(F.col("path").alias("entity"), "u"))
    hits = search(made, replaced(spec)).withColumnRenamed("entity", "path")
    matched = good.select("path", "target", "is_link", *["fields"] * show).join(hits, "path")
    if show:
        matched = matched.join(summaries(matched), "path").drop("fields")
    return scanned, matched, fresh


def replaced(spec: SearchSpec) -> SearchSpec:
    """The specification for units that are already narrowed to the fields asked for."""
    from dataclasses import replace

    values = {f: getattr(spec, f) for f in ("terms", "excluded", "regex", "case_sensitive", "mode", "scope", "snippets")}
    return replace(SearchSpec(terms=spec.terms), **values)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counters: scanned, matched, duplicates, unreadable, cached, read, links skipped."""
    a = tables["scanned"].agg(F.count_if(F.col("skipped").isNull()).alias("scanned"), F.count_if(F.col("error").isNotNull()).alias("unreadable"), F.count_if(F.col("cached")).alias("cached"), F.count_if(~F.col("cached")).alias("read"), F.count_if(F.col("skipped").isNotNull()).alias("skipped_links"))
    m = tables["matched"].agg(F.count("*").alias("all"))
    r = tables["results"].agg(F.count("*").alias("matched"))
    return a.join(m).join(r).select("scanned", "matched", (F.col("all") - F.col("matched")).alias("duplicates"), "unreadable", "cached", "read", "skipped_links")


def skipped_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) of the links that are not followed."""
    return tables["scanned"].where("skipped is not null").groupBy(F.col("skipped").alias("kind")).agg(F.count("*").alias("n"))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files outside the folders (dir) that are done."""
    return files.join(done.select("dir").distinct(), "dir", "left_anti")


def error_kinds(tables: dict[str, DataFrame], broken: bool = False) -> DataFrame:
    """(kind, n) of the errors: by the class before the colon, or by the category in brackets."""
    kind: Column = broken_reason(F.col("error")) if broken else F.substring_index("error", ":", 1)
    return tables["scanned"].where("error is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))

