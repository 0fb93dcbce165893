"""Table states after a write, and the writers themselves.

The state functions are plain DataFrame operators. Where a batch is small, its side of the anti join is
broadcast by run-time size and the stored rows are streamed without a shuffle.

A table is a folder of versions. A manifest of the table tells which version of each of its parts counts: observation years,
buckets of a key's hash, or, in a log, what was appended per day. Writers that stage a table write parts and a manifest, which
nobody reads yet; ``commit_tables`` then puts one manifest of the root in place that names the manifest of every table, so readers see
the changes of several tables together or not at all. Putting a manifest in place is a rename that fails if the name is
taken. That is atomic on HDFS and local disks; object stores without such a rename need one writer per root at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tenorline.catalog import empty_frame
from tenorline.operators.dedupe import last_write_wins
from tenorline.operators.joins import salted_join
from tenorline.schemas import ORDERED_STAGING, TABLES, conform

VERSION = "v="
STAGED = "w="  # version folders of tables by key and of logs, which may follow versions of an older layout
KEPT_VERSIONS = 3
STAGING_TABLE = "staging_observations"
YEARLY, YEAR = (STAGING_TABLE, "raw_observations"), "observation_year"
MANIFESTS = "_manifests"
COMMITS = "_commits"
BUCKET = "bucket"
BUCKETS = 64  # parts of a table stored by key; fixed, as stored rows lie where it put them
LOGS, DAY = ("equity_payloads",), "fetch_day"


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], preserve: tuple[str, ...] = (),
           seq: str | None = None, newest: str | None = None) -> DataFrame:
    """Stored rows with the batch's rows replacing those of the same key.

    With ``newest``, a batch row whose value of that column is below the stored row's is left out; where either has none it replaces.

    ``preserve`` columns keep their stored value. A batch that may repeat a key names the column ``seq`` that
    orders its writes.
    """
    batch = new if seq is None else last_write_wins(new, keys, seq).drop(seq)
    if newest is not None:
        later = existing.select(*keys, F.col(newest).alias("_held")).where(F.col("_held").isNotNull())
        both = [batch[name] == later[name] for name in keys]
        batch = batch.join(later, [*both, batch[newest] < later["_held"]], "left_anti")
    kept = existing.join(batch.select(*keys), keys, "left_anti")
    if preserve:
        stored = existing.select(*keys, *[F.col(name).alias(f"_stored_{name}") for name in preserve])
        batch = batch.join(stored, keys, "left").withColumns(
            {name: F.coalesce(f"_stored_{name}", name) for name in preserve}).drop(*[f"_stored_{n}" for n in preserve])
    return kept.select(*existing.columns).unionByName(batch.select(*existing.columns))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those whose key occurs in the batch, plus the batch; an empty batch removes nothing."""
    kept = salted_join(existing, new.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows plus the batch; duplicates stay."""
    return existing.unionByName(new.select(*existing.columns))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Current state of a stored table; a typed empty frame before its first write. Of a log, the newest version of each key."""
    schema, path = TABLES[name].schema, f"{root}/{name}"
    held = committed_parts(spark, path)
    if held and name in LOGS:
        return conform(last_write_wins(_read_parts(spark, path, held, DAY, keep_version=True), list(TABLES[name].keys), STAGED[:-1]), schema)
    if held:
        return conform(_read_parts(spark, path, held, YEAR if name in YEARLY else BUCKET), schema)
    version = None if name in YEARLY else current_version(spark, root, name)
    if version is None:
        return empty_frame(spark, schema)
    return conform(spark.read.parquet(_version_path(root, name, version)), schema)


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Write a new version of a table. Readers switch to it once its job has committed.

    The stored state may be an input of ``df``: the old version is left in place. Versions older than the
    last ``KEPT_VERSIONS`` are removed.
    """
    spark = df.sparkSession
    version = (current_version(spark, root, name) or 0) + 1
    conform(df, TABLES[name].schema).write.mode("overwrite").parquet(_version_path(root, name, version))
    for old in range(max(1, version - 2 * KEPT_VERSIONS), version - KEPT_VERSIONS + 1):
        remove(spark, _version_path(root, name, old))


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append to the current version of a table."""
    version = current_version(df.sparkSession, root, name) or 1
    conform(df, TABLES[name].schema).write.mode("append").parquet(_version_path(root, name, version))


def bootstrap(spark: SparkSession, root: str) -> None:
    """Create every missing versioned table, empty."""
    for name, table in TABLES.items():
        if name not in YEARLY and current_version(spark, root, name) is None:
            write_table(empty_frame(spark, table.schema), root, name)


def upsert_yearly(new: DataFrame, root: str, name: str) -> None:
    """Upsert rows of a table that is stored by observation year; a batch rewrites only the years it touches."""
    commit_tables(new.sparkSession, root, {name: stage_years(new, root, name)})


def stage_years(new: DataFrame, root: str, name: str) -> int:
    """Stage an upsert into a table stored by observation year; gives the manifest to commit.

    Staging rows keep the order of their fetch (``listed``), and an older fetch does not replace a newer one. Rows without an order always replace.
    """
    schema, newest = (ORDERED_STAGING, "listed") if name == STAGING_TABLE else (TABLES[name].schema, None)
    dated = conform(new, schema).withColumn(YEAR, F.year("observation_date"))
    keys = [*TABLES[name].keys, YEAR]
    return _stage(dated, f"{root}/{name}", YEAR, lambda old, batch: upsert(old, batch, keys, newest=newest))


def stage_replacement(new: DataFrame, root: str, name: str, keys: list[str]) -> int:
    """Stage rows of a table in place of all stored rows of their keys. The table is stored by the hash of ``keys``; only buckets of the batch are rewritten."""
    return _stage(_bucketed(new, root, name, keys), f"{root}/{name}", BUCKET, lambda old, batch: replace_by_key(old, batch, [*keys, BUCKET]))


def stage_upsert(new: DataFrame, root: str, name: str) -> int:
    """Stage an upsert by the table's own key, stored by its hash."""
    keys = list(TABLES[name].keys)
    return _stage(_bucketed(new, root, name, keys), f"{root}/{name}", BUCKET, lambda old, batch: upsert(old, batch, [*keys, BUCKET]))


def stage_append(new: DataFrame, root: str, name: str, day: Column) -> int:
    """Stage rows at the end of a log. Nothing stored is read or rewritten; readers take the newest row of each key."""
    return _stage(conform(new, TABLES[name].schema).withColumn(DAY, day.cast("string")), f"{root}/{name}", DAY, None)


def compact_log(spark: SparkSession, root: str, name: str, appends: int = 2) -> None:
    """Rewrite the days of a log with ``appends`` or more versions as one, which holds the newest row of each key."""
    path = f"{root}/{name}"
    held = committed_parts(spark, path)
    versions = {}
    for part in held:
        versions.setdefault(part.partition("@")[0], []).append(part)
    crowded = {day: parts for day, parts in versions.items() if len(parts) >= appends}
    if crowded:
        rows = _read_parts(spark, path, {part: held[part] for parts in crowded.values() for part in parts}, DAY, keep_version=True)
        newest = last_write_wins(rows, [*TABLES[name].keys, DAY], STAGED[:-1]).drop(STAGED[:-1])
        kept = {part: version for part, version in held.items() if part.partition("@")[0] not in crowded}
        commit_tables(spark, root, {name: _stage(newest, path, DAY, None, kept)})


def commit_tables(spark: SparkSession, root: str, staged: dict[str, int]) -> None:
    """Make staged manifests count, all at once. Fails if another writer has committed since they were staged."""
    number, tables = _last_commit(spark, root)
    for name, manifest in staged.items():
        if _read_json(spark, f"{root}/{name}/{MANIFESTS}/{manifest:08d}.json")["base"] != tables.get(name, 0):
            raise RuntimeError(f"{root}/{name} was changed by another writer")
    _put(spark, f"{root}/{COMMITS}", number + 1, {**tables, **staged}, root)
    for old in range(max(1, number - 2 * KEPT_VERSIONS), number - KEPT_VERSIONS + 1):
        remove(spark, f"{root}/{COMMITS}/{old:08d}.json")


def upsert_staging(new: DataFrame, root: str) -> None:
    upsert_yearly(new, root, STAGING_TABLE)


def read_staging(spark: SparkSession, root: str) -> DataFrame:
    """Stored staging rows; a typed empty frame before the first write."""
    return read_table(spark, root, STAGING_TABLE)


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    """Highest committed version of a table, read from the folder names."""
    folder, fs = _folder(spark, f"{root}/{name}")
    if not fs.exists(folder):
        return None
    versions = [status.getPath() for status in fs.listStatus(folder) if status.getPath().getName().startswith(VERSION)]
    done = [int(path.getName()[len(VERSION):]) for path in versions
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
    return max(done, default=None)


def _bucketed(new: DataFrame, root: str, name: str, keys: list[str]) -> DataFrame:
    """The batch with its buckets. Rows of a table that has no buckets yet move into them with the first batch."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    version = None if committed_parts(spark, f"{root}/{name}") else current_version(spark, root, name)
    if version is not None:
        new = replace_by_key(read_table(spark, root, name), conform(new, TABLES[name].schema), keys)
    return conform(new, TABLES[name].schema).withColumn(BUCKET, bucket)


def _stage(new: DataFrame, path: str, partition: str, merge, kept: dict[str, str] | None = None) -> int:
    """Write the parts that a batch touches and a manifest that names them; gives the manifest's number.

    ``partition`` is derived from the key, so a key never moves between parts. The batch is computed once, into a
    work folder; ``merge`` makes the new state of the touched parts from the old one and the batch, and without it the batch is added to them.
    Until the manifest is committed readers see the old state, and so they do if the job dies. Version folders that neither the last
    ``KEPT_VERSIONS`` manifests nor the committed one name are removed.
    """
    spark = new.sparkSession
    base = _committed_number(spark, path)
    held = _manifest(spark, path, base) if kept is None else kept
    number = _last_number(spark, path) + 1
    version = f"{VERSION if partition == YEAR else STAGED}{number:08d}"
    work = f"{path}/_work-{uuid.uuid4().hex}"
    try:
        new.write.partitionBy(partition).parquet(work)
        touched = [name[len(partition) + 1:] for name in _names(spark, work) if name.startswith(f"{partition}=")]
        parts = {value if merge else f"{value}@{number:08d}": version for value in touched}
        if touched:
            batch = spark.read.schema(new.schema).parquet(work)
            old = {value: held[value] for value in touched if value in held}
            state = merge(_read_parts(spark, path, old, partition, schema=new.schema), batch) if merge and old else batch
            state.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition).parquet(f"{path}/{version}")
        commit_manifest(spark, path, number, {**held, **parts}, base)
    finally:
        remove(spark, work)
    return number


def committed_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """Part of a table to the version folder that counts."""
    return _manifest(spark, path, _committed_number(spark, path))


def _committed_number(spark: SparkSession, path: str) -> int:
    root, _, name = path.rpartition("/")
    return _last_commit(spark, root)[1].get(name, 0)


def commit_manifest(spark: SparkSession, path: str, number: int, parts: dict[str, str], base: int = 0) -> None:
    """Store ``parts``, made from the manifest ``base``, as a state of a table, which counts once the root names it. Fails if another writer has taken the number."""
    _put(spark, f"{path}/{MANIFESTS}", number, {"base": base, "parts": parts}, path)
    used = {version for n in range(max(1, number - KEPT_VERSIONS + 1), number + 1) for version in _manifest(spark, path, n).values()}
    used |= set(committed_parts(spark, path).values())
    for name in _names(spark, path):
        # An older layout's versions stay until the table is written anew under manifests.
        old_layout = name.startswith(VERSION) and any(version.startswith(STAGED) for version in parts.values())
        if name.startswith((VERSION, STAGED)) and not old_layout and name not in used and int(name[len(VERSION):]) <= number:
            remove(spark, f"{path}/{name}")


def _put(spark: SparkSession, folder: str, number: int, content: dict, what: str) -> None:
    target, fs = _folder(spark, f"{folder}/{number:08d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(json.dumps(content, sort_keys=True).encode())
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"{what} was changed by another writer")


def remove(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def _last_number(spark: SparkSession, path: str) -> int:
    return max((int(name[:-5]) for name in _names(spark, f"{path}/{MANIFESTS}") if name.endswith(".json")), default=0)


def _last_commit(spark: SparkSession, root: str) -> tuple[int, dict[str, int]]:
    number = max((int(name[:-5]) for name in _names(spark, f"{root}/{COMMITS}") if name.endswith(".json")), default=0)
    return number, _read_json(spark, f"{root}/{COMMITS}/{number:08d}.json") if number else {}


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    return _read_json(spark, f"{path}/{MANIFESTS}/{number:08d}.json").get("parts", {})


def _read_json(spark: SparkSession, path: str) -> dict:
    file, fs = _folder(spark, path)
    if not fs.exists(file):
        return {}
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _read_parts(spark: SparkSession, path: str, parts: dict[str, str], partition: str, keep_version: bool = False, schema: T.StructType | None = None) -> DataFrame:
    folders = [f"{path}/{version}/{partition}={value.partition('@')[0]}" for value, version in sorted(parts.items())]
    reader = spark.read.option("basePath", path)
    rows = (reader if schema is None else reader.schema(schema)).parquet(*folders)
    return rows if keep_version else rows.drop(VERSION[:-1], STAGED[:-1])


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _folder(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; a cell is quoted only if it holds a quote, comma or line break; CRLF line ends."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("lineSep", "\r\n").csv(path))


def _version_path(root: str, name: str, version: int) -> str:
    return f"{root}/{name}/{VERSION}{version:08d}"
