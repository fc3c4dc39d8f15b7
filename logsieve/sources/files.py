"""Files: discovery, the two acceptance checks, decoding, duplicates, safe names.

A file row is ``file_id, job_id, filename, content binary, created_at``; ``content`` is at most the
size limit of the policy, so one file fits one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.ordering import block_bucket, numbered, running_sum
from logsieve.functions.text import any_glob, base_name, extension
from logsieve.session import materialise
from logsieve.settings import PRINTABLE_SHARE, SCAN_BYTES, FilePolicy, WatchConfig

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
#: Entries a task sees below one folder before it hands the rest on, folders a task is given, and rows it returns at once.
_WALKED, _FOLDERS, _ROWS = 2000, 2000, 8192
#: Files and bytes a task reads, and bytes it holds.
_FILES, _READ, _HELD = 4000, 64 << 20, 8 << 20


def discover(spark: SparkSession, config: WatchConfig) -> DataFrame:
    """Files below the watched roots that match an include glob and no exclude glob, up to the size limit.

    Folders are listed and files are read by tasks, so neither names nor contents pass through the driver; what the
    globs or the size limit leave out is not read. Roots may be globs. Columns are those of Spark's reader of binary
    files, and as there hidden names (``.x``, ``_x``) and empty files are passed over. Folders are listed at the call, contents are read
    when the result is. Tasks reach files through ``pyarrow.fs``; roots in a store it does not know go to Spark's reader,
    which lists on the driver.
    """
    listed, elsewhere = [], []
    for root in _resolved(spark, config.roots):
        (listed if _reachable(root) else elsewhere).append(root)
    found = []
    if listed or not elsewhere:
        found.append(_with_content(matching_paths(_small(list_files(spark, listed), config), config)))
    if elsewhere:
        reader = spark.read.format("binaryFile").options(**_listing(config))
        found.append(matching_paths(_small(reader.load(elsewhere), config), config))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path, modificationTime, length`` of every file below the roots (full URIs).

    A task walks a folder until it has seen ``_WALKED`` entries and returns the folders it has not come to; they are
    dealt out anew until none is left. One folder is listed by one task, whatever it holds.
    """
    kinds = "path string, modificationTime timestamp, length long, is_folder boolean"
    folders, parts, files = spark.createDataFrame([(r,) for r in roots], "path string"), max(1, len(roots)), None
    while True:
        seen = materialise(folders.repartition(parts, "path").mapInArrow(_walk, kinds), "listed")
        here = seen.where("not is_folder").drop("is_folder")
        files = here if files is None else files.unionByName(here)
        folders = seen.where("is_folder").select("path")
        left = folders.count()
        if not left:
            return files
        parts = max(spark.sparkContext.defaultParallelism, -(-left // _FOLDERS)) if left > 1 else 1


def _resolved(spark: SparkSession, roots: tuple[str, ...]) -> list[str]:
    """Roots as full URIs, globs expanded; a root that another one covers goes, so that no file comes twice."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), set()
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(conf)
        matched = store.globStatus(store.makeQualified(path))
        if not matched:
            raise FileNotFoundError(f"watched folder {root} does not exist")
        found.update(status.getPath().toString() for status in matched)

    def covered(root: str) -> bool:
        return any(
            root.startswith(f"{other.rstrip('/')}/") and not any(_hidden(name, True) for name in root[len(other.rstrip("/")) + 1 :].split("/"))
            for other in found if other != root
        )

    return sorted(r for r in found if not covered(r))


def _hidden(name: str, folder: bool) -> bool:
    """What Spark's readers pass over."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _store(uri: str):
    """File system of a URI, and what stands before its paths there and in the URI. Hadoop's URIs are not escaped."""
    import pyarrow.fs

    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "", "file:"
    authority = rest[2:].split("/", 1)[0]
    store, base = pyarrow.fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, base.rstrip("/"), f"{scheme}://{authority}"


def _reachable(uri: str) -> bool:
    try:
        _store(uri)
    except (OSError, pa.ArrowException):
        return False
    return True


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSelector, FileType

    def batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.bool_()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "modificationTime", "length", "is_folder"])

    def rows(start: str) -> Iterator[tuple]:
        store, base, prefix = _store(start)
        waiting, walked = [base + start[len(prefix) :]], 0
        first = store.get_file_info(waiting)[0]
        while waiting and walked < _WALKED:
            folder = waiting.pop()
            entries = [first] if first.type == FileType.File else store.get_file_info(FileSelector(folder, allow_not_found=True))
            walked += 1 + len(entries)
            for entry in entries:
                if _hidden(entry.base_name, entry.type == FileType.Directory):
                    continue
                if entry.type == FileType.Directory:
                    waiting.append(entry.path)
                elif entry.type == FileType.File and entry.size:
                    yield prefix + entry.path[len(base) :], entry.mtime_ns // 1_000_000 * 1000, entry.size, False
        for path in waiting:
            yield prefix + path[len(base) :], None, None, True

    found = (row for given in batches for start in given.column(0).to_pylist() for row in rows(start))
    while made := list(islice(found, _ROWS)):
        yield batch(made)


def _with_content(listed: DataFrame) -> DataFrame:
    """``content`` of every listed file; a task holds files of ``_HELD`` bytes, or one that is larger."""
    listed = materialise(listed, "wanted")
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, -(-n // _FILES), -(-size // _READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}

        def content(path: str) -> bytes:
            root = "/".join(path.split("/", 3)[:3]) if "://" in path else "file:"
            if root not in stores:
                stores[root] = _store(path)
            store, base, prefix = stores[root]
            with store.open_input_stream(base + path[len(prefix) :]) as stream:
                return stream.read()

        for batch in batches:
            first, held, contents = 0, 0, []
            for at, path in enumerate(batch.column(0).to_pylist(), 1):
                contents.append(content(path))
                held += len(contents[-1])
                if held >= _HELD or at == batch.num_rows:
                    piece = batch.slice(first, at - first)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(contents, pa.binary())], names=[*piece.schema.names, "content"])
                    first, held, contents = at, 0, []

    return listed.repartition(parts, "path").mapInArrow(run, BINARY_FILE)


def _listing(config: WatchConfig) -> dict[str, str]:
    names = sorted({glob.rsplit("/", 1)[-1] for glob in config.include_globs})
    return {"recursiveFileLookup": "true", "pathGlobFilter": "{" + ",".join(names) + "}"}


def _small(found: DataFrame, config: WatchConfig) -> DataFrame:
    return found.where(F.col("length") <= config.max_file_size_mb * 1024 * 1024)


def discover_stream(spark: SparkSession, config: WatchConfig, files_per_trigger: int = 1000) -> DataFrame:
    """The same as an endless source; each root is watched by its own file stream. Other names and large files are not read."""
    streams = [
        _small(spark.readStream.format("binaryFile").schema(BINARY_FILE).options(**_listing(config))
               .option("maxFilesPerTrigger", files_per_trigger).load(root), config)
        for root in config.roots
    ]
    found = streams[0]
    for other in streams[1:]:
        found = found.unionByName(other)
    return matching_paths(found, config)


def matching_paths(files: DataFrame, config: WatchConfig, path: str = "path") -> DataFrame:
    return files.where(any_glob(F.col(path), config.include_globs) & ~any_glob(F.col(path), config.exclude_globs))


def precheck(files: DataFrame, policy: FilePolicy = FilePolicy()) -> DataFrame:
    """Name and size check before any byte is sent: adds ``reasons`` and ``is_allowed``.

    A name without extension is refused here.
    """
    ext = extension(F.col("filename"))
    shown = F.when(ext == "", F.lit("<none>")).otherwise(ext)
    reasons = F.array_compact(F.array(
        F.when(~ext.isin(policy.extensions), F.concat(F.lit("Unsupported file extension: ."), shown)),
        F.when(
            F.col("file_size") > policy.max_bytes,
            F.concat(
                F.lit("File size "), F.col("file_size").cast("string"),
                F.lit(f" exceeds limit of {policy.max_bytes} bytes"),
            ),
        ),
    ))
    return files.withColumn("reasons", reasons).withColumn("is_allowed", F.size("reasons") == 0)


def printable_share(content: Column) -> Column:
    """Share of printable bytes in the head of a file."""
    head = F.decode(F.substring(content, 1, SCAN_BYTES), "ISO-8859-1")
    kept = F.length(F.regexp_replace(head, "[^\\x20-\\x7E\\t\\n\\r]", ""))
    return F.when(F.length(head) > 0, kept / F.length(head))


def upload_gate(files: DataFrame, policy: FilePolicy = FilePolicy()) -> DataFrame:
    """Acceptance of received bytes: adds ``reject_reason``, null when accepted.

    A name without extension passes here. The size is checked before the content is looked at.
    """
    ext = extension(F.coalesce("filename", F.lit("")))
    size = F.octet_length("content")
    reason = (
        F.when(
            (ext != "") & ~ext.isin(policy.extensions),
            F.concat(F.lit("Unsupported file extension '."), ext, F.lit("'")),
        )
        .when(size > policy.max_bytes, F.lit(f"File exceeds limit of {policy.max_bytes} bytes"))
        .when(size == 0, F.lit("Empty files are not allowed"))
        .when(
            printable_share(F.col("content")) < PRINTABLE_SHARE,
            F.lit("File appears to be binary data which is not supported"),
        )
    )
    return files.withColumn("reject_reason", reason)


def decode_text(files: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """UTF-8, or Latin-1 for the whole file when it is not valid UTF-8; line ends become ``\\n``."""
    raw = F.col(content)
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )
    return files.withColumn(text, F.regexp_replace(decoded, "\\r\\n?", "\n"))


def add_checksum(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("checksum", F.sha2(F.col(content), 256)).withColumn(
        "file_size", F.octet_length(content)
    )


def reject_duplicates(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds ``is_duplicate``: the checksum came earlier (by ``created_at, file_id``) or is stored.

    The first file of each checksum comes from a partial aggregate, so a checksum shared by a third
    of all files costs one row per task; whole rows are only ever shuffled by file id. The rows are
    read twice, so give written ones without contents rather than a plan that hashes.
    """
    firsts = files.groupBy("checksum").agg(F.min(F.struct("created_at", "file_id")).alias("_first"))
    if stored is not None:
        firsts = firsts.join(stored.select("checksum"), "checksum", "left_anti")
    winners = firsts.select(F.col("_first.file_id").alias("file_id"), F.lit(True).alias("_wins"))
    return (
        files.join(winners, "file_id", "left")
        .withColumn("is_duplicate", F.col("_wins").isNull())
        .drop("_wins")
    )


def safe_name(filename: Column) -> Column:
    """Base name with unusual characters replaced and outer dots and underscores removed."""
    name = base_name(filename)
    named = F.when(name == "", F.lit("upload")).otherwise(name)
    cleaned = F.regexp_replace(F.regexp_replace(named, "[^a-zA-Z0-9._-]", "_"), "^[._]+|[._]+$", "")
    return F.when(cleaned == "", F.lit("upload")).otherwise(cleaned)


def store_names(files: DataFrame, bucket: Column) -> DataFrame:
    """Adds ``stored_name``: the safe name, with ``.1``, ``.2`` … from the second file of a job on.

    The first file of every safe name keeps it, and repeats skip numbers that some other file of
    the job bears as its own name (``a.log.1`` beside two ``a.log``), so stored names are unique.
    """
    named = files.withColumn("_safe", safe_name(F.col("filename")))
    keys = ["job_id", "_safe"]
    ordered = numbered(named, keys, ["created_at", "file_id"], bucket, "_nth")
    # 18 digits are more than any number of files, so longer suffixes are never in the way
    own = F.regexp_extract("_safe", "^(.*)\\.([1-9]\\d{0,17})$", 2)
    taken = named.select(
        "job_id", F.regexp_extract("_safe", "^(.*)\\.([1-9]\\d{0,17})$", 1).alias("_safe"), own.alias("_suffix")
    ).where("_suffix <> ''").distinct().withColumn("_suffix", F.col("_suffix").cast("long"))
    ranked = numbered(taken, keys, ["_suffix"], block_bucket("_suffix"), "_rank")
    # the k-th free number is k and one more for every taken number with fewer than k free ones below it; taken numbers
    # are put among the files at that place and counted along, block by block
    markers = ranked.select(*keys, (F.col("_suffix") - F.col("_rank")).alias("_at"), F.lit(0).alias("_file"))
    placed = ordered.withColumns({"_at": (F.col("_nth") - 1).cast("long"), "_file": F.lit(1)}).unionByName(
        markers, allowMissingColumns=True
    )
    passed = running_sum(placed, keys, ["_at", "_file"], block_bucket("_at"), 1 - F.col("_file"), "_passed")
    # a marker at the same place is a taken number with exactly k free ones below: not yet in the way
    same = placed.where("_file = 0").groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_same"))
    found = passed.where("_file = 1").join(same, [*keys, "_at"], "left")
    suffix = F.col("_at") + F.col("_passed") - F.coalesce("_same", F.lit(0))
    name = F.when(F.col("_nth") == 1, F.col("_safe")).otherwise(F.concat("_safe", F.lit("."), suffix.cast("string")))
    return found.withColumn("stored_name", name).select(*files.columns, "stored_name")


def job_files(files: DataFrame, job_id=None) -> DataFrame:
    """Descriptors of the files of a job (or of every job), oldest first."""
    chosen = files if job_id is None else files.where(F.col("job_id") == job_id)
    wanted = ["job_id", "file_id", "file_path", "filename", "checksum", "content_type", "file_size", "created_at"]
    return chosen.select(*[c for c in wanted if c in chosen.columns]).orderBy("job_id", "created_at", "file_id")
