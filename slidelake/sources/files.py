"""File listings, ranged fingerprints, tensor files, images, label discovery."""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.functions.hashing import CHUNK, MODES
from slidelake.functions.parsing import class_from_path, file_name, stem
from slidelake.operators.skew import spread
from slidelake.session import materialize

# Fixed set of slide file suffixes.
SLIDE_SUFFIXES = ("svs", "tif", "tiff", "ndpi", "mrxs", "scn")


def _located(root: str):
    """File system of ``root``, the root in its terms, and what stands before such a path in full."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if ":/" in root else os.path.abspath(root))
    plain = root.rstrip("/")
    head = "" if system.type_name == "local" or not plain.endswith(base.rstrip("/")) else plain[: len(plain) - len(base.rstrip("/"))]
    return system, base, head


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """Path, whether it is a folder, size and time of what lies in ``folder``.

    On a local or mounted file system the names are streamed without a look at the files, which leaves sizes and times open;
    others tell both as they list.  A link that leads back up to a folder above itself is not followed.
    """
    from pyarrow import fs

    system, base, head = _located(folder)
    if system.type_name != "local":
        for i in system.get_file_info(fs.FileSelector(base)):
            if i.type == fs.FileType.Directory:
                yield head + i.path, True, None, None
            elif i.is_file:
                yield head + i.path, False, i.size, i.mtime_ns // 1000
        return
    here = os.path.join(os.path.realpath(base), "")
    with os.scandir(base) as listed:
        for e in listed:
            if not e.is_dir():
                yield e.path, False, None, None
            elif not (e.is_symlink() and here.startswith(os.path.join(os.path.realpath(e.path), ""))):
                yield e.path, True, None, None


_LISTED = "path string, is_folder boolean, length bigint, micros bigint"


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str], batch_rows: int = 10_000) -> DataFrame:
    """Path, length and modificationTime of all files below ``root`` that end in one of ``suffixes`` (lower or upper case).

    Empty files and names that begin with a dot or an underscore are listed too.  The driver lists nothing: each level of
    folders is a job whose tasks share the folders and write the names they find; then the files are spread evenly and looked
    at, so that one folder with very many files is many tasks' work.  A file that is gone by then keeps a row without length
    and time.  A folder that cannot be read is an error.
    """
    wanted = tuple(f".{x}" for s in suffixes for x in (s, s.upper()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                hits = (e for e in _entries(folder) if e[1] or e[0].endswith(wanted))
                while rows := list(itertools.islice(hits, batch_rows)):
                    yield pd.DataFrame(rows, columns=["path", "is_folder", "length", "micros"]).astype({"length": "Int64", "micros": "Int64"})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, times = [], []
            for path, size, at in zip(batch["path"], batch["length"], batch["micros"]):
                if pd.isna(size):
                    try:
                        found = os.stat(path)
                        size, at = found.st_size, found.st_mtime_ns // 1000
                    except FileNotFoundError:
                        size = at = None
                sizes.append(size)
                times.append(at)
            yield pd.DataFrame(
                {"path": batch["path"], "length": pd.array(sizes, dtype="Int64"), "micros": pd.array(times, dtype="Int64")}
            )

    _, base, head = _located(root)
    # Local rows would start Python workers of their own, beside those of the tasks.
    folders, levels = spark.range(1).select(F.lit(head + base).alias("path")), []
    while True:
        names = materialize(spread(folders, "path").mapInPandas(scan, _LISTED), "names")
        levels.append(names.where("NOT is_folder").drop("is_folder"))
        folders = names.where("is_folder").select("path")
        if folders.isEmpty():
            break
    names = functools.reduce(DataFrame.unionByName, levels)
    seen = spread(names, "path").mapInPandas(look, "path string, length bigint, micros bigint")
    return seen.select("path", "length", F.timestamp_micros("micros").alias("modificationTime"))


def file_inventory(spark: SparkSession, root: str, suffixes: Sequence[str] = SLIDE_SUFFIXES) -> DataFrame:
    """One row per file below the root, empty files included; contents are not read."""
    listed = list_files(spark, root, suffixes)
    base = re.sub("^file:/*", "/", root)
    return listed.select(
        "path",
        file_name("path").alias("filename"),
        stem("path").alias("slide_id"),
        class_from_path("path", base).alias("cancer_code"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_time"),
    )


def _digest(path: str, size: int, mode: str, chunk: int) -> str:
    """Fingerprint of one file, reading only the bytes the mode needs."""
    if mode == "size_only":
        return f"SIZE:{size}"
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    h = hashlib.sha1()
    with system.open_input_file(inner) as f:
        if mode == "sha1_full":
            while block := f.read(1 << 20):
                h.update(block)
            return f"SHA1:{h.hexdigest()}"
        h.update(f.read(chunk))
        if size > chunk:
            h.update(f.read_at(chunk, size - chunk))
    h.update(str(size).encode())
    return f"QSHA1:{h.hexdigest()}"


def fingerprint_files(files: DataFrame, mode: str = "sha1_quick", chunk: int = CHUNK) -> DataFrame:
    """Add ``fingerprint`` and ``fingerprint_error`` to rows with path and size_bytes.

    Slides are often larger than a binary column may be, so files are opened in
    the tasks and only their first and last chunk is read.  The small rows are
    spread first: a file is megabytes of reading.
    """
    if mode not in MODES:
        raise ValueError(f"unknown fingerprint mode: {mode}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints, errors = [], []
            for path, size in zip(batch["path"], batch["size_bytes"]):
                try:
                    prints.append(_digest(path, int(size), mode, chunk))
                    errors.append(None)
                except Exception as e:  # one bad file must not fail the job
                    prints.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(fingerprint=prints, fingerprint_error=errors)

    added = [T.StructField(c, T.StringType()) for c in ("fingerprint", "fingerprint_error")]
    schema = T.StructType([*files.schema.fields, *added])
    return spread(files, "path").mapInPandas(run, schema)


def npy_ingest(files: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows of (path, tile_idx, feat) from ``.npy`` contents; bad files keep a row with an error.

    ``files`` has path and content, as the binaryFile reader gives them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                    if a.ndim != 2 or (dim is not None and a.shape[1] != dim):
                        raise ValueError(f"bad_shape{tuple(a.shape)}")
                except Exception as e:  # one bad file must not fail the job
                    yield pd.DataFrame({"path": [path], "tile_idx": [None], "feat": [None], "error": [str(e)]})
                    continue
                rows = a.astype(np.float32)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pd.DataFrame(
                        {
                            "path": path,
                            "tile_idx": np.arange(at, at + len(part)),
                            "feat": list(part),
                            "error": None,
                        }
                    )

    return files.select("path", "content").mapInPandas(
        run, "path string, tile_idx bigint, feat array<float>, error string"
    )


def _npy_head(f) -> tuple[int, int, str, bool, int]:
    """Rows, columns, type, whether columns come first, and where the values begin, of an open ``.npy`` file."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if len(shape) != 2:
        raise ValueError(f"bad_shape{tuple(shape)}")
    if dtype.kind not in "biuf":
        raise ValueError(f"bad_type({dtype})")
    start = f.tell()
    if f.size() < start + shape[0] * shape[1] * dtype.itemsize:
        raise ValueError(f"truncated({f.size()} of {start + shape[0] * shape[1] * dtype.itemsize} bytes)")
    return shape[0], shape[1], dtype.str, fortran, start


def _npy_rows(f, head: tuple[int, int, str, bool, int], at: int, n: int) -> np.ndarray:
    """Rows ``at`` to ``at + n`` by seeking; only their bytes are read."""
    rows, cols, kind, fortran, start = head
    size = np.dtype(kind).itemsize
    if not fortran:
        return np.frombuffer(f.read_at(n * cols * size, start + at * cols * size), kind).reshape(n, cols)
    parts = [np.frombuffer(f.read_at(n * size, start + (c * rows + at) * size), kind) for c in range(cols)]
    return np.stack(parts, axis=1) if parts else np.zeros((n, 0), kind)


def npy_ranges(files: DataFrame, dim: int | None = None, range_bytes: int = 64 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """Rows of (path, tile_idx, feat, error) from ``.npy`` files of any size, given their ``path``.

    The headers are read first; then each file is cut into ranges of about ``range_bytes`` that are spread over the tasks, which
    seek to theirs.  So a task holds one batch of ``batch_bytes``, and a file of many GB is many tasks' work.  A file that is no
    table of numbers, has another width than ``dim`` or ends early gives one row with an ``error`` and no other; where a range
    cannot be read after its header could, that range gives such a row.
    """
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    system, inner, _ = _located(path)
                    with system.open_input_file(inner) as f:
                        head = _npy_head(f)
                    if dim is not None and head[1] != dim:
                        raise ValueError(f"bad_shape{head[:2]}")
                    out.append((path, *head, None))
                except Exception as e:  # one bad file must not fail the job
                    out.append((path, 0, 0, "", False, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "n_rows", "n_cols", "kind", "fortran", "start", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                error = r.error
                if error is None:
                    head = (r.n_rows, r.n_cols, r.kind, r.fortran, r.start)
                    step = max(1, batch_bytes // max(1, r.n_cols * np.dtype(r.kind).itemsize))
                    try:
                        system, inner, _ = _located(r.path)
                        with system.open_input_file(inner) as f:
                            for at in range(r.first, r.first + r.n, step):
                                part = _npy_rows(f, head, at, min(step, r.first + r.n - at)).astype(np.float32)
                                ids = np.arange(at, at + len(part))
                                yield pd.DataFrame({"path": r.path, "tile_idx": ids, "feat": list(part), "error": None})
                    except Exception as e:  # as above
                        error = f"{type(e).__name__}: {e}"
                if error is not None:
                    yield pd.DataFrame({"path": [r.path], "tile_idx": [None], "feat": [None], "error": [error]})

    known = spread(files.select("path"), "path").mapInPandas(
        heads, "path string, n_rows bigint, n_cols bigint, kind string, fortran boolean, start bigint, error string"
    )
    width = F.greatest(F.lit(1), F.col("n_cols") * F.substring("kind", 3, 9).try_cast("int"))
    step = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / width)).cast("bigint")
    firsts = (
        F.when(F.col("error").isNotNull(), F.array(F.lit(0).cast("bigint")))
        .when(F.col("n_rows") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1, step))
    )
    ranges = known.withColumn("step", step).withColumn("first", F.explode(firsts))
    ranges = ranges.withColumn("n", F.least("step", F.col("n_rows") - F.col("first"))).drop("step")
    return spread(ranges, "path", "first").mapInPandas(run, "path string, tile_idx bigint, feat array<float>, error string")


def read_npy(spark: SparkSession, root: str, dim: int | None = None) -> DataFrame:
    return npy_ranges(list_files(spark, root, ["npy"]), dim)


def image_scan(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: path, width, height, channels, pixel bytes in BGR order, and error.

    An image that cannot be read keeps its row: sizes and bytes are NULL, and ``error`` says so.
    """
    df = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    bad = F.col("image")["width"] <= 0
    i = F.when(~bad, F.col("image"))
    return df.select(
        F.col("image")["origin"].alias("path"),
        i["width"].alias("width"),
        i["height"].alias("height"),
        i["nChannels"].alias("channels"),
        i["data"].alias("data"),
        F.when(bad, F.lit("unreadable image")).alias("error"),
    )


def discover_label_files(spark: SparkSession, root: str) -> DataFrame:
    """The CSV with a staging header and the shortest file name, if there is one.

    Only the start of each file is read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            headers = []
            for path in batch["path"]:
                try:
                    system, inner = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(inner) as f:
                        headers.append(io.TextIOWrapper(f, "utf-8-sig", errors="replace").readline().strip())
                except Exception:  # an unreadable file is no candidate
                    headers.append(None)
            yield batch.assign(header=headers)

    first = list_files(spark, root, ["csv"]).select("path").mapInPandas(run, "path string, header string")
    clean = F.regexp_replace(F.lower("header"), r'["\s]', "")
    cols = F.split(clean, ",")

    def has(*names: str):
        out = F.lit(True)
        for n in names:
            out = out & F.array_contains(cols, n)
        return out

    fits = has("patient", "pn") | has("case", "pn") | has("patient", "stage")
    name = file_name("path")
    best = first.where(fits).agg(F.min_by(F.struct("path", cols.alias("columns")), F.struct(F.length(name), F.col("path"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select("b.path", F.concat_ws(",", "b.columns").alias("columns"))


def artefact_table(spark: SparkSession, root: str, suffixes: Sequence[str] = ("pt", "pth", "safetensors"), recent: int = 6) -> DataFrame:
    """The latest model files: size in MB, short digest, whether they can be read, and how many files there are in all."""
    listed = list_files(spark, root, suffixes)
    n_files = listed.count()
    latest = (
        listed.orderBy(F.col("modificationTime").desc(), F.col("path").desc())
        .limit(recent)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for path in batch["path"]:
                try:
                    system, inner = fs.FileSystem.from_uri(path)
                    h = hashlib.sha256()
                    with system.open_input_stream(inner) as f:
                        while block := f.read(1 << 20):
                            h.update(block)
                    digests.append(h.hexdigest()[:12])
                except Exception:  # an unreadable file is reported, not raised
                    digests.append(None)
            yield batch.assign(sha256_12=digests)

    schema = T.StructType([*latest.schema.fields, T.StructField("sha256_12", T.StringType())])
    hashed = latest.mapInPandas(run, schema)
    return hashed.select(
        "path",
        F.col("modificationTime").alias("modified_time"),
        F.round(F.col("length") / (1024.0**2), 2).alias("size_mb"),
        "sha256_12",
        (F.col("sha256_12").isNotNull() & (F.col("length") > 0)).alias("load_ok"),
        F.lit(n_files).cast("bigint").alias("n_files"),
    )


__all__ = [
    "SLIDE_SUFFIXES",
    "artefact_table",
    "discover_label_files",
    "file_inventory",
    "fingerprint_files",
    "image_scan",
    "list_files",
    "npy_ingest",
    "npy_ranges",
    "read_npy",
]
