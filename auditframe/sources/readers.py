"""Sources: text artifacts, tables in text, manifests, ranked lists."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from auditframe.functions.scalars import truthy
from auditframe.operators import setdigest
from auditframe.session import ship

# Folders that are left out, suffixes that are read, size tiers.
EXCLUDED = ("node_modules", ".git", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".idea", ".next", "site-packages")
SUFFIXES = ("py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "go", "java", "kt", "php", "rb", "cs", "html", "htm", "vue", "svelte", "sql", "json", "jsonl", "yaml", "yml", "toml", "ini", "conf", "env", "md", "txt", "csv", "tsv", "log", "xml", "sh", "dockerfile")
FULL_BYTES, BOUNDED_BYTES = 5 << 20, 20 << 20
#: Digits that name a place of the tree of contents beyond ``setdigest.FAN`` leaves; the digest's definition, so it stays as it is.
TREE_DIGITS = 1
_MAGIC = ("25504446", "89504E47", "FFD8FF", "504B0304", "1F8B", "7F454C46", "CAFEBABE", "4D5A", "53514C69746520666F726D6174")


def files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """SRC1, SRC2: files under ``root`` by the allow-list: path, suffix, n_bytes, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    parts = F.split("path", "/")
    out = raw.select("path", F.when(name == "dockerfile", "dockerfile").otherwise(suffix).alias("suffix"), F.col("length").alias("n_bytes"), "content")
    out = out.filter(F.col("suffix").isin(*SUFFIXES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))))
    return out.filter(F.col("n_bytes") <= max_bytes) if max_bytes else out


def decode_bytes(data: bytes | None) -> str | None:
    """SRC3: text of a file, or None for a binary: UTF-16 by mark or by zeros, UTF-8, then Korean code pages, Latin-1."""
    if data is None or any(data.startswith(bytes.fromhex(m)) for m in _MAGIC):
        return None
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    head = data[:4096]
    if len(head) >= 4 and (head[1::2].count(0) > len(head) // 4 or head[0::2].count(0) > len(head) // 4):
        return data.decode("utf-16-le" if head[1::2].count(0) >= head[0::2].count(0) else "utf-16-be", "replace")
    if b"\0" in head:
        return None
    for code in ("utf-8-sig", "cp949", "euc-kr"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def decoded(raw: DataFrame, content: str = "content") -> DataFrame:
    """SRC3, SRC4: ``text`` of files; valid UTF-8 stays in built-in functions, other bytes go to Python."""
    ship(raw.sparkSession)

    @F.pandas_udf("string")
    def other(s: pd.Series) -> pd.Series:
        return s.map(lambda b: decode_bytes(bytes(b)) if b is not None else None)

    c = F.col(content)
    plain = F.expr(f"is_valid_utf8(cast({content} as string))") & ~F.contains(F.substring(c, 1, 4096), F.unhex(F.lit("00")))
    utf8 = raw.filter(F.coalesce(plain, F.lit(False))).withColumn("text", F.regexp_replace(c.cast("string"), "^\\uFEFF", ""))
    return utf8.unionByName(raw.filter(~F.coalesce(plain, F.lit(False))).withColumn("text", other(c)))


def tier(path: Column, n_bytes: Column, n_lines: Column) -> Column:
    """SRC6: how far an artifact is looked at."""
    script = path.rlike("(?i)\\.(js|mjs|cjs|ts)$")
    noise = script & (n_bytes > 512 << 10) & (n_bytes / F.greatest(n_lines, F.lit(1)) > 4096)
    return F.when(n_bytes > BOUNDED_BYTES, "unscanned").when(n_bytes > FULL_BYTES, "bounded_large").when(noise | path.rlike("(?i)\\.min\\.(js|css)$|\\.map$"), "path_secret_only").otherwise("full")


def inventory_fingerprint(artifacts: DataFrame, most_bytes: int = BOUNDED_BYTES) -> DataFrame:
    """SRC5, SRC18: one row of counts and exact set digests of all paths, and of all paths with their contents.

    From (path, content, n_bytes): files, bytes, unreadable (no content), oversized (above ``most_bytes``), whether the digest of
    contents is complete, path_set_sha256 and tree_digest. Paths count by their lower case, a missing or oversized content by
    that word; see ``setdigest`` for the digests, which are the same for any order and partitioning. The tree of contents is
    at most two levels deep (``TREE_DIGITS``).
    """
    path = F.lower(F.coalesce("path", F.lit("")))
    size = F.coalesce("n_bytes", F.lit(0))
    state = F.when(F.col("content").isNull(), "unreadable").when(size > most_bytes, "oversized").otherwise(F.sha2(F.col("content").cast("binary"), 256))
    counts = artifacts.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(F.col("content").isNull()).alias("unreadable"), F.count_if(F.col("content").isNotNull() & (size > most_bytes)).alias("oversized"))
    paths = setdigest.set_digest(artifacts, setdigest.framed(path), name="path_set_sha256").drop("n_entries")
    tree = setdigest.set_digest(artifacts, setdigest.framed(path, state), name="tree_digest", most_digits=TREE_DIGITS).drop("n_entries")
    # Three tables of one row each.
    return counts.join(F.broadcast(paths)).join(F.broadcast(tree)).withColumn("complete", (F.col("unreadable") == 0) & (F.col("oversized") == 0))


def embedded_csv(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """SRC7: cells of tables that stand in texts: (key, row, header, value); the separator is the one of the header line."""
    ship(texts.sparkSession)
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                head = (t or "").lstrip("\ufeff").split("\n", 1)[0]
                mark = max(",\t;", key=head.count)
                if not head.count(mark):
                    continue
                rows = list(csv.reader(io.StringIO(t.lstrip("\ufeff")), delimiter=mark))
                if len(rows) < 2:
                    continue
                names = ["".join(h.lower().split()) for h in rows[0]]
                out += [(k, n, names[c] if c < len(names) else "", v) for n, row in enumerate(rows[1:], 2) for c, v in enumerate(row) if v.strip()]
            yield pd.DataFrame(out, columns=[key, "row", "header", "value"])

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, row int, header string, value string")


def manifest(spark: SparkSession, path: str, schema: str | StructType, flags: tuple[str, ...] = ()) -> DataFrame:
    """SRC14: a CSV with header: byte-order mark and blanks off, empty as null, ``flags`` as booleans."""
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", multiLine=True)
    for name, kind in df.dtypes:
        if kind == "string":
            clean = F.trim(F.regexp_replace(F.col(name), "^\\uFEFF", ""))
            df = df.withColumn(name, truthy(clean) if name in flags else F.when(clean != "", clean))
    return df


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: headerless rows name, category, real, cwe with ``#`` comments; a name of another form raises."""
    df = spark.read.csv(path, comment="#", schema="test_name string, category string, real string, cwe int")
    name = F.when(F.col("test_name").rlike("^BenchmarkTest[0-9]{5}$"), F.col("test_name")).otherwise(F.raise_error(F.concat(F.lit("bad case name: "), F.coalesce("test_name", F.lit("")))).cast("string"))
    return df.select(name.alias("test_name"), "category", truthy(F.col("real")).alias("real_vulnerability"), "cwe")


def ranked_domains(raw: DataFrame, limit: int, start: int = 1, cohort: str = "general") -> DataFrame:
    """SRC17: rows (rank, domain) to numbered targets: normal form, first rank of each domain, from rank ``start`` on."""
    domain = F.regexp_replace(F.lower(F.trim("domain")), "^(https?://)?(www\\.)?|/.*$", "")
    rows = raw.select(F.col("rank").cast("int").alias("rank"), domain.alias("domain")).filter("rank is not null and domain rlike '^[a-z0-9.-]+[.][a-z]{2,}$'")
    first = rows.groupBy("domain").agg(F.min("rank").alias("rank")).filter(F.col("rank") >= start).orderBy("rank", "domain").limit(limit)
    n = F.row_number().over(Window.orderBy("rank", "domain"))
    return first.select(F.format_string("target-%04d", n).alias("target_id"), F.lit(cohort).alias("cohort"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), "rank", "domain")


def sample_under_grant(df: DataFrame, columns: list[str], limit: int = 25) -> DataFrame:
    """SRC9, T6: named columns only and a literal limit, each row as JSON for the detectors."""
    return df.select(*columns).limit(limit).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("text"))
