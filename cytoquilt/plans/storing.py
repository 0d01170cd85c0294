"""Queries of inputs, writers, the versioned store, configuration and views: each writes what it needs to the shared folder and reads it back."""

from __future__ import annotations

import json
from dataclasses import asdict, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..model import AnnMatrix
from ..operators import ingest as I
from ..operators import layout as L
from ..operators import select as S
from ..operators.embed import covariance as covariance_of
from ..operators.positions import positions, running_total
from ..session import table
from ..sources import config as C
from ..sources.files import Files, cut, scratch
from ..sources.inputs import read_any
from ..sources.readers import read_triplets
from ..sources.store import Store, StoreError, matrix, open_x
from . import convert as V
from . import multiuser as M
from . import pipeline, querybench
from .binding import X, counts, extent, obs, var

BLOCK_ROWS, SEGMENT = 2048, 100_000
BENCH = 1000


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _folder(spark, d) -> str:
    """The matrix as a folder of Parquet tables."""
    where = scratch(spark, "folder")
    for name, df in (("obs", obs(spark, d)), ("var", var(spark, d)), ("x", counts(spark, d))):
        df.write.parquet(f"{where}/{name}.parquet")
    return where


def _store(spark, d, fmt: str = "csr", **parts) -> Store:
    store = Store.create(spark, scratch(spark, "store"))
    store.write(AnnMatrix(obs=obs(spark, d), var=var(spark, d), x=counts(spark, d), **parts), fmt, message="write")
    return store


def _refused(f) -> str:
    """What an operation that must not work says, as a word."""
    try:
        f()
    except (StoreError, I.IngestError, S.SelectionError, ValueError, NotImplementedError) as e:
        return type(e).__name__
    return "done"


# ---- inputs


def read_input_folder(spark, d):
    return read_any(spark, _folder(spark, d)).x


def read_mtx(spark, d):
    """A MatrixMarket file of all entries, its places from 1, written as text and read back."""
    where = scratch(spark, "mtx")
    x = counts(spark, d)
    Files(spark, where).create("0-head.mtx", f"%%MatrixMarket matrix coordinate real general\n{extent(obs(spark, d), 'row_id')} {extent(var(spark, d), 'col_id')} {x.count()}\n")
    x.select(F.concat_ws(" ", F.col("row_id") + 1, F.col("col_id") + 1, F.col("value").cast("long")).alias("value")).write.text(f"{where}/1-entries")
    head = spark.read.text(f"{where}/0-head.mtx")
    size = head.where(~F.col("value").startswith("%")).select(F.split("value", " ").alias("s"))
    entries = read_triplets(spark, f"{where}/1-entries", sized=False)
    return entries.join(F.broadcast(size), F.lit(True)).where((F.col("row_id") < F.col("s")[0].cast("long")) & (F.col("col_id") < F.col("s")[1].cast("long"))).select("row_id", "col_id", "value")


def open_uri(spark, d):
    """A store opened by a path with a scheme."""
    store = _store(spark, d)
    uri = store.files.fs.makeQualified(store.files._path(store.root)).toString()
    return Store.open(spark, uri).load().obs.select("row_id", "cell_type")


def open_branch(spark, d):
    """An input read at the tip of a branch, where main has other cells."""
    store = _store(spark, d)
    store.create_branch("few")
    s = store.writable("few")
    s.write("obs", S.matching(s.read("obs"), cell_type="1-URGENT"), sort=["row_id"])
    s.commit("few cells")
    both = [read_any(spark, store.root, b).obs.select("row_id", F.lit(b).alias("branch")) for b in ("main", "few")]
    return both[0].union(both[1])


def lazy_blocks(spark, d):
    """X read in blocks of rows, all genes of a row together."""
    x = matrix(_store(spark, d).readonly())
    return x.groupBy(F.floor(F.col("row_id") / BLOCK_ROWS).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("total"))


def scan_cohort(spark, d):
    """A cohort table read lazily: what is not selected is not read."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("kit"), F.col("c_mktsegment").alias("cohort"))


def stream_copy(spark, d):
    """X under a second name without a copy of its files, read from there."""
    s = _store(spark, d).writable()
    s.staged["X_copy"] = dict(s.node("X"))
    s.commit("copy")
    return matrix(s, "X_copy")


def server_health(spark, d):
    return _rows(spark, [(api.health()["status"],)], "status string")


# ---- writers


def convert_commits(spark, d):
    """A conversion is one commit on a new store; writing there again without leave is refused."""
    where, target = _folder(spark, d), scratch(spark, "out")
    V.convert(spark, where, target)
    store = Store.open(spark, target)
    again = _refused(lambda: V.convert(spark, where, target))
    return _rows(spark, [(len(store.ancestry()) - 1, store.ancestry()[0]["message"].split(" ")[0], again)], "commits int, message string, again string")


def convert_sorted(spark, d):
    """A conversion with grouping: X follows the cells into the order of the keys."""
    target = scratch(spark, "out")
    V.convert(spark, _folder(spark, d), target, C.override(C.AppConfig(), sort_by=["cell_type", "batch"]))
    return Store.open(spark, target).load().x


def write_dispatch(spark, d):
    """Every entry through both sparse formats of one writer. Places are added up as decimals; the sum is a long, as in SQL, unless it is beyond longs, where SQL has no answer."""
    out = []
    for fmt in ("csr", "csc"):
        s = _store(spark, d, fmt).readonly()
        places = (F.col("row_id") * F.col("col_id")).cast("decimal(38,0)")
        out.append(matrix(s).agg(F.lit(open_x(s)["format"]).alias("format"), F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("total"), F.sum(places).alias("places")))
    rows = out[0].union(out[1]).collect()  # one row for each format
    if any(r["places"] is not None and abs(r["places"]) >= 1 << 63 for r in rows):
        return _rows(spark, rows, "format string, nnz long, total double, places decimal(38,0)")
    return _rows(spark, [(r["format"], r["nnz"], r["total"], None if r["places"] is None else int(r["places"])) for r in rows], "format string, nnz long, total double, places long")


def _dense(spark, d) -> AnnMatrix:
    """The embeddings as a dense matrix of rows by dimensions."""
    e = table(spark, d, "embeddings")
    x = e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("p", "v")).select("row_id", F.col("p").cast("long").alias("col_id"), F.col("v").cast("double").alias("value"))
    dims = x.select("col_id").distinct().withColumn("var_name", F.concat(F.lit("d"), "col_id"))
    return AnnMatrix(obs=e.select(F.col("vec_id").alias("row_id"), "label"), var=dims, x=x, layers={"raw": x})


def write_dense(spark, d):
    """A dense matrix written as dense tiles, as a layer too, and read back."""
    store = Store.create(spark, scratch(spark, "dense"))
    store.write(_dense(spark, d), "dense", chunk=(256, 16))
    s = store.readonly()
    return matrix(s, "layers/raw").join(matrix(s).select(F.col("row_id").alias("r"), F.col("col_id").alias("c"), F.col("value").alias("x")), (F.col("row_id") == F.col("r")) & (F.col("col_id") == F.col("c"))).where("value = x").select("row_id", "col_id", F.round("value", 5).alias("value"))


def densify_band(spark, d):
    """Bands of rows with all their columns filled in: cells, zeros among them, and sum."""
    ann = _dense(spark, d)
    n_cols = extent(ann.var, "col_id")
    sparse = ann.x.where("value > 0")
    rows = L.dense_rows(L.compressed(sparse), n_cols)
    filled = rows.select(F.floor(F.col("row_id") / 100).cast("long").alias("band"), F.size("values").alias("n"), F.size(F.filter("values", lambda v: v == 0)).alias("z"), F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("s"))
    return filled.groupBy("band").agg(F.sum("n").alias("n_values"), F.sum("z").alias("zeros"), F.round(F.sum("s"), 4).alias("total"))


def flat_segments(spark, d):
    """The flat arrays in segments of a fixed length: entries and sum of each."""
    x = cut(counts(spark, d))
    nnz = positions(L.major_nnz(obs(spark, d), x), [])
    start = running_total(nnz, "position", "nnz", "end").select(F.col("row_id").alias("r"), (F.col("end") - F.col("nnz")).alias("start"))
    cells = L.compressed(x).join(start, F.col("row_id") == F.col("r")).select("start", F.posexplode("data").alias("p", "value"))
    return cells.groupBy(F.floor((F.col("start") + F.col("p")) / SEGMENT).cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def csr_batches(spark, d):
    """Batches of rows, as parts of a concatenated matrix are written: rows and entries of each."""
    nnz = L.major_nnz(obs(spark, d), counts(spark, d))
    return nnz.groupBy(F.floor(F.col("row_id") / BLOCK_ROWS).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("nnz").alias("nnz"))


def codec_info(spark, d):
    s = _store(spark, d).readonly()
    files = s.read("X").inputFiles()
    return _rows(spark, [("zstd", bool(files) and all(".zstd." in f for f in files))], "codec string, all_files boolean")


def ann_tree(spark, d):
    """The nodes of a store after a matrix with all its parts was written."""
    o, v = obs(spark, d), var(spark, d)
    vec = o.select("row_id", F.array(F.col("total"), -F.col("total")).alias("vec"))
    pairs = o.select("row_id", (F.col("row_id") + 1).alias("row_id2"), F.lit(1.0).alias("value"))
    raw = AnnMatrix(obs=o, var=v, x=counts(spark, d))
    store = _store(spark, d, layers={"counts": counts(spark, d)}, obsm={"X_umap": vec}, varm={"PCs": v.select("col_id", F.array(F.lit(1.0)).alias("vec"))}, obsp={"distances": pairs}, varp={"near": v.select("col_id", F.col("col_id").alias("col_id2"), F.lit(1.0).alias("value"))}, uns={"title": "all parts"}, raw=raw)
    return _rows(spark, [(k, n["kind"]) for k, n in store.readonly().nodes.items()], "node string, kind string")


def write_cleaned(spark, d):
    """The cleaned metadata as one Parquet table."""
    where = scratch(spark, "cleaned")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("subject"), F.trim("c_name").alias("name"), F.col("c_nationkey").cast("smallint").alias("nation")).distinct()
    c.write.parquet(where)
    return spark.read.parquet(where)


def axis_read(spark, d):
    """Rows and columns by ids, one axis after the other."""
    x = S.by_frame(counts(spark, d), "row_id", obs(spark, d).where("row_id % 7 = 0"), "row_id")
    return S.by_frame(x, "col_id", var(spark, d).where("col_id % 5 = 0"), "col_id")


def dtype_warnings(spark, d):
    """What a concatenation on chosen columns drops and widens."""
    o, v, x = obs(spark, d), var(spark, d), counts(spark, d)
    other = o.withColumn("total", F.col("total").cast("int")).withColumn("extra", F.lit(1))
    found = I.check_parts([I.Part(o, v, x), I.Part(other, v, x)], ["cell_type", "total"])
    return _rows(spark, [(w,) for w in found], "warning string")


# ---- analytics that need a word of their own


def float64_cast(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v), 5).alias("norm2"))


def raw_gate(spark, d):
    """Counts are normalised; what has been normalised is left alone."""
    ann = AnnMatrix(obs=obs(spark, d), var=var(spark, d), x=counts(spark, d))
    once = ann.normalized()
    twice = once.normalized()
    total = lambda a, n: a.x.agg(F.lit(n).alias("step"), F.round(F.sum("value"), 3).alias("total"))
    return total(ann, "raw").union(total(once, "once")).union(total(twice, "twice"))


def covariance(spark, d):
    """The matrix that PCA decomposes, entry by entry."""
    points = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    c, n = covariance_of(points)
    return _rows(spark, [(i, j, round(float(c[i, j]), 6), n) for i in range(len(c)) for j in range(len(c))], "i int, j int, covariance double, n long")


# ---- checks


def validate_rules(spark, d):
    """What each rule of validation says."""
    o, v = obs(spark, d), var(spark, d).limit(5)
    cases = {
        "good": lambda: I.validate(o, v),
        "no X": lambda: I.validate(o, v, has_x=False),
        "spatial in uns": lambda: I.validate(o, v, uns={"spatial": 1}),
        "spatial in obsm": lambda: I.validate(o, v, obsm=("X_Spatial",)),
        "spatial allowed": lambda: I.validate(o, v, uns={"spatial": 1}, reject_spatial=False),
        "empty": lambda: I.validate(o.where("false"), v),
        "empty allowed": lambda: I.validate(o.where("false"), v, require_non_empty=False),
    }
    return _rows(spark, [(k, _refused(f)) for k, f in cases.items()], "rule string, result string")


# ---- versions


def store_life(spark, d):
    where = scratch(spark, "life")
    steps = [("before", str(Store.exists(spark, where))), ("open", _refused(lambda: Store.open(spark, where)))]
    Store.open_or_create(spark, where).write(AnnMatrix(obs=obs(spark, d)), message="first")
    steps += [("after", str(Store.exists(spark, where))), ("create", _refused(lambda: Store.create(spark, where))), ("open_or_create", str(len(Store.open_or_create(spark, where).ancestry())))]
    Store.create(spark, where, overwrite=True)
    steps.append(("overwrite", str(len(Store.open(spark, where).ancestry()))))
    return _rows(spark, steps, "step string, result string")


def sessions(spark, d):
    """Cells that a reader, a writer and a later reader see around a commit."""
    store = _store(spark, d)
    early, s = store.readonly(), store.writable()
    s.write("obs", S.matching(s.read("obs"), batch="F"), sort=["row_id"])
    seen = [("early", early), ("staged", s), ("other", store.readonly())]
    out = [x.read("obs").agg(F.lit(n).alias("session"), F.count(F.lit(1)).alias("cells")) for n, x in seen]
    s.commit("fewer")
    out += [x.read("obs").agg(F.lit(n).alias("session"), F.count(F.lit(1)).alias("cells")) for n, x in (("early, later", early), ("late", store.readonly()))]
    out.append(_rows(spark, [(f"read-only write: {_refused(lambda: early.write('x', obs(spark, d)))}", 0)], "session string, cells long"))
    return reduce(DataFrame.union, out)


def commit_race(spark, d):
    """Of two writers from one snapshot, the second is refused and nothing of it is seen."""
    store = _store(spark, d)
    a, b = store.writable(), store.writable()
    a.set_uns({"by": "a"})
    b.set_uns({"by": "b"})
    first, second = _refused(lambda: a.commit("a")), _refused(lambda: b.commit("b"))
    return _rows(spark, [(first, second, store.readonly().nodes["uns"]["value"]["by"], len(store.ancestry()))], "first string, second string, seen string, snapshots int")


def branches(spark, d):
    """Cells of each branch after one moved on and main was set to it."""
    store = _store(spark, d)
    for name in ("dev", "old"):
        store.create_branch(name)
    s = store.writable("dev")
    s.write("obs", S.matching(s.read("obs"), batch="O"), sort=["row_id"])
    s.commit("only O")
    moved = store.lookup("main") == store.lookup("dev")
    store.reset_branch("main", store.lookup("dev"))
    per = [store.readonly(b).read("obs").agg(F.lit(b).alias("branch"), F.count(F.lit(1)).alias("cells"), F.lit(moved).alias("moved_early"), F.lit(store.lookup(b) == store.lookup("dev")).alias("at_dev")) for b in store.branches()]
    return reduce(DataFrame.union, per)


def ancestry(spark, d):
    """A branch's commits, newest first."""
    store = _store(spark, d)
    for n in range(3):
        s = store.writable()
        s.set_uns({"n": n})
        s.commit(f"step {n}")
    return _rows(spark, [(i, s["message"]) for i, s in enumerate(store.ancestry())], "age int, message string")


def rerun_skips(spark, d):
    """Steps that are on main already are not done again."""
    store = Store.create(spark, scratch(spark, "rerun"))
    ann = AnnMatrix(obs=obs(spark, d), var=var(spark, d), x=counts(spark, d))
    runs = [(k, M.ingest(store, ann) is not None, M.add_normalized(store, "ana") is not None) for k in range(2)]
    return _rows(spark, runs, "run int, ingested boolean, normalised boolean")


def sharing(spark, d):
    """A layer added on a branch: raw X keeps its folder, the layer has its own, and both read right."""
    store = Store.create(spark, scratch(spark, "share"))
    M.ingest(store, AnnMatrix(obs=obs(spark, d), var=var(spark, d), x=counts(spark, d)))
    before = store.readonly().node("X")["dir"]
    M.add_normalized(store, "ana")
    s = store.readonly()
    read = matrix(s).agg(F.count(F.lit(1)).alias("raw_nnz"), F.sum("value").alias("raw_total")).join(matrix(s, "layers/norm").agg(F.count(F.lit(1)).alias("norm_nnz")), F.lit(True))
    return read.select(F.lit(before == s.node("X")["dir"]).alias("shared"), F.lit(before != s.node("layers/norm")["dir"]).alias("own"), "raw_nnz", "raw_total", "norm_nnz")


def remote_backends(spark, d):
    """Places that this build does not reach are refused with a word."""
    gcs = C.override(C.AppConfig(), icechunk_storage="gcs", backend="icechunk")
    return _rows(spark, [("gs path", _refused(lambda: Store(spark, "gs://bucket/x"))), ("gcs place", _refused(lambda: V._target(spark, scratch(spark, "g"), gcs)))], "place string, result string")


# ---- configuration and command line


def _flat(cfg: C.AppConfig) -> list[tuple[str, str, str]]:
    return [(s, k, json.dumps(list(v) if isinstance(v, tuple) else v)) for s, part in asdict(cfg).items() for k, v in part.items()]


def config_sections(spark, d):
    """All sections of a configuration that sets some keys, one of them a bare name where a list may stand."""
    cfg = C.from_dict({"io": {"x_storage": "DENSE", "overwrite": True}, "chunks": {"x_row_chunk": 10}, "grouping": {"enabled": True, "sort_by": "AIFI_L1"}, "concat": {"obs_columns": ["a", "b"]}})
    return _rows(spark, _flat(cfg), "section string, key string, value string")


def config_errors(spark, d):
    cases = {
        "section": {"nothing": {}}, "key": {"io": {"nothing": 1}}, "storage": {"io": {"x_storage": "rows"}}, "zero": {"chunks": {"cpus": 0}},
        "no keys": {"grouping": {"enabled": True}}, "backed": {"io": {"backend": "icechunk", "backed": True}}, "fine": {"io": {"backend": "zarr", "backed": True}},
    }
    return _rows(spark, [(k, _refused(lambda v=v: C.from_dict(v))) for k, v in cases.items()], "config string, result string")


def config_overrides(spark, d):
    """Flags over a configuration: those given win, and sort keys switch grouping on."""
    cfg = C.override(C.from_dict({"chunks": {"cpus": 2}}), x_storage="sparse-csc", cpus=4, sort_by=["cell_type"], obs_columns=["a"], x_row_chunk=None)
    return _rows(spark, [r for r in _flat(cfg) if r not in _flat(C.AppConfig())], "section string, key string, value string")


def api_names(spark, d):
    return _rows(spark, [(n, callable(getattr(api, n))) for n in api.__all__], "name string, callable boolean")


def bench_record(spark, d):
    """What a timed selection reads, without its times."""
    store = _store(spark, d)
    runs = [querybench.run(spark, store.root, "row", "sequential", count=BENCH, repeats=1, warmup=0), querybench.run(spark, store.root, "row", "celltype", obs_column="cell_type", obs_value="1-URGENT", repeats=1, warmup=0)]
    return _rows(spark, [(r["mode"], r["format"], r["nnz"], r["n_selected"]) for r in runs], "mode string, format string, nnz long, n_selected long")


def pipeline_flags(spark, d):
    return _rows(spark, [(f.name, str(f.default)) for f in fields(pipeline.Settings)], "flag string, value string")


# ---- viewer


def viewer_groups(spark, d):
    """What the group picker lists: every level's groups by size, decoded."""
    o = obs(spark, d)
    levels = [o.groupBy(F.lit(level).alias("level"), F.col(level).alias("name")).agg(F.count(F.lit(1)).alias("cells")) for level in ("cell_type", "batch")]
    return reduce(DataFrame.union, levels)


def viewer_level(spark, d):
    """A level's codes for each point in the order of the cells, and -1 where a point has none; codes are ranks of names."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.when(F.col("vec_id") % 11 != 0, F.concat(F.lit("group "), F.col("label"))).alias("name"))
    codes = positions(e.where("name is not null").groupBy("name").agg(F.min("row_id").alias("first")), ["name"], "first", "code").select(F.col("name").alias("n2"), "code")
    return e.join(codes, F.col("name") == F.col("n2"), "left").select("row_id", "name", F.coalesce("code", F.lit(-1)).cast("long").alias("code"))


def viewer_legend(spark, d):
    """The legend of the level shown: names, codes, sizes and the share of all points."""
    v = viewer_level(spark, d)
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("code", F.coalesce("name", F.lit("unassigned")).alias("name")).agg(F.count(F.lit(1)).alias("cells")).join(F.broadcast(n), F.lit(True)).select("code", "name", "cells", F.round(F.col("cells") / F.col("n"), 6).alias("share"))


_FUNCTIONS = (
    read_input_folder, read_mtx, open_uri, open_branch, lazy_blocks, scan_cohort, stream_copy, server_health, convert_commits, convert_sorted, write_dispatch, write_dense, densify_band, flat_segments, csr_batches, codec_info,
    ann_tree, write_cleaned, axis_read, dtype_warnings, float64_cast, raw_gate, covariance, validate_rules, store_life, sessions, commit_race, branches, ancestry, rerun_skips, sharing, remote_backends,
    config_sections, config_errors, config_overrides, api_names, bench_record, pipeline_flags, viewer_groups, viewer_level, viewer_legend,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _values(names: str, *rows: tuple) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({names})"


_XR = "r as row_id, c as col_id, v as value from x"
_DENSE = "p as (select vec_id as r, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as c from embeddings)"
_LEVEL = "e as (select vec_id as row_id, case when vec_id % 11 <> 0 then 'group ' || label end as name from embeddings), k as (select name, row_number() over (order by name) - 1 as code from (select distinct name from e where name is not null)), l as (select row_id, e.name, coalesce(code, -1)::bigint as code from e left join k on k.name = e.name)"
_DEFAULTS = [
    ("io", "overwrite", "false"), ("io", "consolidate_metadata", "false"), ("io", "x_storage", '"sparse-csr"'), ("io", "backed", "false"), ("io", "backend", '"zarr"'), ("io", "icechunk_storage", '"local"'), ("io", "gcs_bucket", "null"), ("io", "gcs_prefix", '""'),
    ("chunks", "x_row_chunk", "2048"), ("chunks", "x_col_chunk", "2048"), ("chunks", "sparse_flat_chunk", "1000000"), ("chunks", "cpus", "1"), ("chunks", "x_shard_factor", "1"),
    ("validation", "reject_spatial", "true"), ("validation", "require_non_empty", "true"), ("validation", "min_obs", "1"), ("validation", "min_vars", "1"), ("grouping", "enabled", "false"), ("grouping", "sort_by", "[]"), ("concat", "obs_columns", "[]"),
]
_SET = {("io", "x_storage"): '"dense"', ("io", "overwrite"): "true", ("chunks", "x_row_chunk"): "10", ("grouping", "enabled"): "true", ("grouping", "sort_by"): '["AIFI_L1"]', ("concat", "obs_columns"): '["a", "b"]'}
ORACLE = {
    "read_input_folder": f"with {X} select {_XR}",
    "read_mtx": f"with {X} select {_XR}",
    "open_uri": "select o_orderkey as row_id, o_orderpriority as cell_type from orders",
    "open_branch": "select o_orderkey as row_id, 'main' as branch from orders union all select o_orderkey, 'few' from orders where o_orderpriority = '1-URGENT'",
    "lazy_blocks": f"with {X} select (r // {BLOCK_ROWS})::bigint as block, count(*) as nnz, sum(v) as total from x group by 1",
    "scan_cohort": "select c_custkey as kit, c_mktsegment as cohort from customer",
    "stream_copy": f"with {X} select {_XR}",
    "server_health": "select 'ok' as status",
    "convert_commits": "select 1 as commits, 'convert' as message, 'StoreError' as again",
    "convert_sorted": f"with {X}, s as (select row_number() over (order by o_orderpriority, o_orderstatus, o_orderkey) - 1 as position, o_orderkey as k from orders) select position as row_id, c as col_id, v as value from x join s on k = r",
    "write_dispatch": f"with {X}, a as (select count(*) as nnz, sum(v) as total, sum(r * c)::bigint as places from x) select format, a.* from a, (values ('csr'), ('csc')) as f(format)",
    "write_dense": f"with {_DENSE} select r as row_id, c as col_id, round(v, 5) as value from p where v <> 0",
    "densify_band": f"with {_DENSE}, w as (select max(c) + 1 as n from p), q as (select r, count(*) as k, sum(v) as s from p where v > 0 group by r) select (r // 100)::bigint as band, sum(n)::bigint as n_values, sum(n - k)::bigint as zeros, round(sum(s), 4) as total from q, w group by 1",
    "flat_segments": f"with {X}, f as (select row_number() over (order by r, c) - 1 as place, v from x) select (place // {SEGMENT})::bigint as segment, count(*) as n, sum(v) as total from f group by 1",
    "csr_batches": f"with {X}, z as (select o_orderkey as r, count(c) as nnz from orders left join x on r = o_orderkey group by 1) select (r // {BLOCK_ROWS})::bigint as batch, count(*) as n_rows, sum(nnz)::bigint as nnz from z group by 1",
    "codec_info": "select 'zstd' as codec, true as all_files",
    "ann_tree": _values("node, kind", ("obs", "table"), ("var", "table"), ("uns", "dict"), ("obsm/X_umap", "obsm"), ("varm/PCs", "varm"), ("obsp/distances", "obsp"), ("varp/near", "varp"), ("X", "matrix"), ("layers/counts", "matrix"), ("raw/obs", "table"), ("raw/var", "table"), ("raw/X", "matrix")),
    "write_cleaned": "select distinct c_custkey::varchar as subject, trim(c_name) as name, c_nationkey::smallint as nation from customer",
    "axis_read": f"with {X} select {_XR} where r % 7 = 0 and c % 5 = 0",
    "dtype_warnings": _values("warning", ("input 0: dropped obs columns ['batch', 'donor']",), ("input 1: dropped obs columns ['batch', 'donor', 'extra']",), ("total: coerced from ['double', 'int']",)),
    "float64_cast": "select vec_id as row_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 5) as norm2 from embeddings",
    "raw_gate": f"with {X}, t as (select r, sum(v) as t from x group by 1), n as (select round(sum(ln(1 + v * (select quantile_cont(t, 0.5) from t where t > 0) / t.t)), 3) as total from x join t using (r)) select 'raw' as step, round(sum(v), 3) as total from x union all select 'once', total from n union all select 'twice', total from n",
    "covariance": f"with {_DENSE} select a.c::int as i, b.c::int as j, round(covar_samp(a.v, b.v), 6) as covariance, count(*) as n from p a join p b on a.r = b.r group by 1, 2",
    "validate_rules": _values("rule, result", ("good", "done"), ("no X", "IngestError"), ("spatial in uns", "IngestError"), ("spatial in obsm", "IngestError"), ("spatial allowed", "done"), ("empty", "IngestError"), ("empty allowed", "done")),
    "store_life": _values("step, result", ("before", "False"), ("open", "StoreError"), ("after", "True"), ("create", "StoreError"), ("open_or_create", "2"), ("overwrite", "1")),
    "sessions": "with n as (select count(*) as a, count(*) filter (where o_orderstatus = 'F') as f from orders) select s as session, (case when w = 'f' then f else a end)::bigint as cells from n, (values ('early', 'a'), ('staged', 'f'), ('other', 'a'), ('early, later', 'a'), ('late', 'f')) as t(s, w) union all select 'read-only write: StoreError', 0",
    "commit_race": "select 'done' as first, 'StoreError' as second, 'a' as seen, 3 as snapshots",
    "branches": "with n as (select count(*) as a, count(*) filter (where o_orderstatus = 'O') as o from orders) select b as branch, (case when b = 'old' then a else o end)::bigint as cells, false as moved_early, b <> 'old' as at_dev from n, (values ('main'), ('dev'), ('old')) as t(b)",
    "ancestry": _values("age, message", (0, "step 2"), (1, "step 1"), (2, "step 0"), (3, "write"), (4, "created")),
    "rerun_skips": _values("run, ingested, normalised", (0, True, True), (1, False, False)),
    "sharing": f"with {X} select true as shared, true as own, count(*) as raw_nnz, sum(v) as raw_total, count(*) as norm_nnz from x",
    "remote_backends": _values("place, result", ("gs path", "StoreError"), ("gcs place", "NotImplementedError")),
    "config_sections": _values("section, key, value", *((s, k, _SET.get((s, k), v)) for s, k, v in _DEFAULTS)),
    "config_errors": _values("config, result", *((k, "ValueError") for k in ("section", "key", "storage", "zero", "no keys", "backed")), ("fine", "done")),
    "config_overrides": _values("section, key, value", ("io", "x_storage", '"sparse-csc"'), ("chunks", "cpus", "4"), ("grouping", "enabled", "true"), ("grouping", "sort_by", '["cell_type"]'), ("concat", "obs_columns", '["a"]')),
    "api_names": _values("name, callable", *((n, True) for n in ("AppConfig", "GroupingConfig", "load_config", "ConversionError", "ValidationError", "convert_h5ad", "convert_10x_h5", "concat_h5ads", "validate", "health"))),
    "bench_record": f"with {X}, u as (select o_orderkey as k from orders where o_orderpriority = '1-URGENT') select 'sequential' as mode, 'csr' as format, count(*) as nnz, {BENCH} as n_selected from x where r < {BENCH} union all select 'celltype', 'csr', count(*), (select count(*) from u) from x join u on k = r",
    "pipeline_flags": _values("flag, value", ("data_path", ""), ("branch", "main"), ("subset_column", ""), ("subset_value", ""), ("write_results", "True"), ("subset_dir_name", ""), ("umap_key", "X_umap"), ("leiden_key", "leiden"), ("n_top_genes", "2000"), ("n_comps", "30"), ("n_neighbors", "20"), ("neighbors_algorithm", "ivfflat"), ("leiden_resolution", "1.1"), ("leiden_iterations", "100"), ("umap_min_dist", "0.45"), ("batch_key", ""), ("random_seed", "5671"), ("label", "")),
    "viewer_groups": "select 'cell_type' as level, o_orderpriority as name, count(*) as cells from orders group by 2 union all select 'batch', o_orderstatus, count(*) from orders group by 2",
    "viewer_level": f"with {_LEVEL} select * from l",
    "viewer_legend": f"with {_LEVEL} select code, coalesce(name, 'unassigned') as name, count(*) as cells, round(count(*) / (select count(*) from l), 6) as share from l group by 1, 2",
}
