"""Tables of the knowledge base: schemas, reading, insert-if-absent, updates, cascading deletes, rebuilds."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "users": "id string, username string, email string, hashed_password string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz, last_login timestamp_ntz, mfa_enabled boolean, mfa_secret string, full_name string, bio string, phone string, avatar_url string",
    "conversations": "id string, user_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean",
    "messages": "id string, conversation_id string, user_id string, content string, role string, model_used string, tokens_used int, response_time double, created_at timestamp_ntz, extra_metadata string",
    "university_data": "id string, url string, title string, content string, content_type string, scraped_at timestamp_ntz, is_active boolean, extra_metadata string",
    "document_chunks": "id string, university_data_id string, chunk_text string, chunk_index int, vector_id string, created_at timestamp_ntz",
    "audit_logs": "id string, user_id string, action string, resource string, details string, ip_address string, user_agent string, timestamp timestamp_ntz",
}
#: The columns of users that a profile update may touch.
PROFILE = ("full_name", "bio", "phone", "avatar_url", "is_active")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at a path; an empty one with this schema if there is none. A table that is there but can't be read is an error."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], ddl)
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # gone since
            return spark.createDataFrame([], ddl)
        raise


def append_rows(rows: DataFrame, path: str, ddl: str) -> None:
    """Appends rows with the declared columns, in their order and types; columns that aren't given are null, others are left out."""
    fields = rows.sparkSession.createDataFrame([], ddl).schema
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").parquet(path)


def create_tables(spark: SparkSession, names: tuple[str, ...] = tuple(SCHEMAS)) -> None:
    """Creates the declared tables in the session's catalog where they are missing."""
    for n in names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {n} ({SCHEMAS[n]}) USING parquet")


def absent(new: DataFrame, existing: DataFrame, key: str = "id", order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key isn't held yet; of several rows of a key the first by ``order``. Null keys are never stored."""
    rows = new.filter(F.col(key).isNotNull())
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), F.struct(*(order or [F.xxhash64(*new.columns)]))).alias("_r")).select(key, "_r.*").select(*new.columns)
    return first.join(existing.select(key), key, "left_anti")


def insert_if_absent(new: DataFrame, path: str, ddl: str, key: str = "id") -> int:
    """Appends the rows whose key is new; returns how many were stored."""
    spark = new.sparkSession
    fresh = absent(new, load_or_empty(spark, path, ddl), key)
    batch = f"{path.rstrip('/')}-batch-{uuid.uuid4().hex}"
    fresh.write.parquet(batch)
    stored = spark.read.schema(fresh.schema).parquet(batch)
    n = stored.count()
    if n:
        stored.write.mode("append").parquet(path)
    _delete(spark, batch)
    return n


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    """A move that failed is an error: file systems tell by a value only."""
    p, fs = _fs(spark, path)
    if not fs.rename(p, _fs(spark, to)[0]):
        raise OSError(f"could not move {path} to {to}")


def swap_in(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Replaces several tables: all are written aside first, and only then moved into place.

    A failed write changes nothing. The moves themselves are one after the other: parquet has no transaction over tables.
    """
    staged = {}
    for path, df in tables.items():
        staged[path] = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
        df.write.parquet(staged[path])
    moved: list[tuple[str, str]] = []
    try:
        for path, new in staged.items():
            target, fs = _fs(spark, path)
            old = f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
            if fs.exists(target):
                _rename(spark, path, old)
                moved.append((old, path))
            _rename(spark, new, path)
    except Exception:
        # Back to what was there; nothing old has been deleted yet.
        for old, path in reversed(moved):
            _delete(spark, path)
            _rename(spark, old, path)
        raise
    for old, _ in moved:
        _delete(spark, old)


def updated(table: DataFrame, patch: DataFrame, key: str = "id", columns: tuple[str, ...] = PROFILE, at: Column | None = None) -> DataFrame:
    """Rows of ``table`` with the allowed columns that ``patch`` has, null where the patch says null; updated_at moves where a row is patched.

    A column that the patch lacks is kept. Of several patches of a key one counts as a whole, the greatest in the order of its columns.
    """
    given = [c for c in columns if c in patch.columns and c in table.columns]
    p = patch.groupBy(key).agg(F.max(F.struct(*[F.col(c).alias(f"_new_{c}") for c in given], F.lit(0).alias("_0"))).alias("_p"), F.lit(True).alias("_hit")).select(key, "_p.*", "_hit")
    out = table.join(p, key, "left")
    cols = []
    for c in table.columns:
        if c in given:
            cols.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and at is not None:
            cols.append(F.when(F.col("_hit"), at).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def cascade(users: DataFrame, conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """What remains of the three tables without the users of ``gone`` (id), their conversations and all their messages."""
    gone = gone.select(F.col("id").alias("_u")).filter("_u IS NOT NULL").distinct()
    theirs = conversations.join(gone, conversations["user_id"] == gone["_u"], "left_semi").select(F.col("id").alias("_c")).distinct()
    kept = messages.join(theirs, messages["conversation_id"] == theirs["_c"], "left_anti")
    return {
        "users": users.join(gone, users["id"] == gone["_u"], "left_anti"),
        "conversations": conversations.join(gone, conversations["user_id"] == gone["_u"], "left_anti"),
        "messages": kept.join(gone, kept["user_id"] == gone["_u"], "left_anti"),
    }


def delete_user(spark: SparkSession, root: str, user_id: str) -> bool:
    """Deletes a user with conversations and messages from the tables under ``root``; False, and no change, if there is none."""
    t = {n: load_or_empty(spark, f"{root}/{n}", SCHEMAS[n]) for n in ("users", "conversations", "messages")}
    if t["users"].filter(F.col("id") == user_id).isEmpty():
        return False
    swap_in(spark, {f"{root}/{n}": df for n, df in cascade(t["users"], t["conversations"], t["messages"], spark.createDataFrame([(user_id,)], "id string")).items()})
    return True


def rebuild(spark: SparkSession, base: DataFrame, derived: DataFrame, path: str) -> bool:
    """Replaces a derived table unless its base is empty."""
    if base.isEmpty():
        return False
    swap_in(spark, {path: derived})
    return True


def clear(spark: SparkSession, path: str, ddl: str | None = None, key: str | None = None, value=None) -> None:
    """Removes a table's rows, or those whose ``key`` is ``value`` (``ddl`` is needed then); rows with a null key stay."""
    if key is None:
        _delete(spark, path)
    else:
        swap_in(spark, {path: load_or_empty(spark, path, ddl).filter(~F.coalesce(F.col(key) == value, F.lit(False)))})
