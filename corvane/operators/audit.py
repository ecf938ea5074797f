"""Audits of a corpus: profiles, provenance findings, leaks, verification, secrets and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import falsy, first_filled, references
from corvane.session import ship
from corvane.tables import BROADCAST_BYTES, materialize, small


def field_profile(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """Rows, distinct ids (first filled candidate, trimmed, capitals), filled texts and their median length."""
    name = F.upper(F.trim(first_filled(*(F.col(i).cast("string") for i in ids))))
    t = falsy(F.trim(F.col(text)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(name).alias("n_ids"), F.count(t).alias("n_filled"),
                  F.median(F.length(t)).cast("int").alias("median_length"))


def group_granularity(df: DataFrame, by: Sequence[str], text: str, header: str) -> DataFrame:
    """Lines and distinct documents per group; a document is named by a header pattern, else by its first 120 characters."""
    key = F.coalesce(falsy(F.regexp_extract(text, header, 1)), F.substring(text, 1, 120))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct(key).alias("n_docs"))


def provenance_findings(profiles: DataFrame) -> DataFrame:
    """Six checks over profiles (family, rows, ids, filled share, coverage before and after, pairing, granularity)."""
    c = F.col
    checks = [
        ("empty_field", c("filled_share") < 0.5), ("coverage_drop", c("coverage_before") - c("coverage_after") > 0.2),
        ("one_id", (c("n_ids") <= 1) & (c("n_rows") > 10)), ("not_expanded", ~c("expanded")),
        ("pairing", c("paired_share") < 0.5), ("granularity", ~c("granularity").between(0.67, 1.5)),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks)), lambda x: x.isNotNull())
    order = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(checks) for x in (name, k)))
    out = profiles.select("family", F.explode(found).alias("finding")).withColumn("severity", F.element_at(order, c("finding")))
    return out.orderBy("severity", "family")


def pairing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either side, those on both, and the share of the left side that is paired."""
    left, right = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both")).withColumn(
        "share", F.try_divide(F.col("n_both"), F.col("n_left")))


def leak_by_prefix(df: DataFrame, block: str, key: str, held_out: Sequence[int]) -> DataFrame:
    """Per block: lines, distinct exam numbers, their range, and those that belong to the held-out exams."""
    n = F.regexp_extract(key, r"^(\d{2})-", 1).try_cast("int")
    d = df.withColumn("__n", n)
    leaked = F.array_sort(F.collect_set(F.when(F.col("__n").isin(*held_out), F.col("__n"))))
    return d.groupBy(block).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("__n").alias("n_exams"), F.min("__n").alias("first_exam"),
                                F.max("__n").alias("last_exam"), leaked.alias("leaked"))


def _blocks(items: DataFrame, limit: int = BROADCAST_BYTES):
    """The items in tables of at most ``limit`` bytes of text (one item may be longer)."""
    rows, size = [], 0
    for row in items.toLocalIterator():
        if rows and size + len(row.item_text or "") * 4 > limit:
            yield items.sparkSession.createDataFrame(rows, items.schema)
            rows, size = [], 0
        rows.append(row)
        size += 4 * len(row.item_text or "")
    if rows:
        yield items.sparkSession.createDataFrame(rows, items.schema)


def contained_items(docs: DataFrame, items: DataFrame, grams: int = 8) -> DataFrame:
    """Items whose text occurs verbatim in some document: candidates by a word-gram hash join, then verified.

    An item is looked up by its first gram only, so the join is on one key an item and not items times documents. An item of
    fewer than ``grams`` + 2 words is looked up by a gram as long as it allows; those of two words or fewer, which may be
    parts of longer words throughout, are searched for in every text. An empty item is in every text that is not null.
    """
    words = lambda c: F.split(F.trim(c), r"\s+")
    # The first and last word may be parts of longer ones in a document, so the gram starts at the second and ends before the last.
    key = items.withColumn("__w", words(F.col("item_text"))).withColumn("__n", F.least(F.size("__w") - 2, F.lit(grams)))
    long = key.where("__n > 0").withColumn("__k", F.xxhash64("__n", F.array_join(F.expr("slice(__w, 2, __n)"), " "))).select("item_id", "item_text", "__k")
    scanned = docs.select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "doc_id").where("false")
    for block in _blocks(key.where("__n <= 0").select("item_id", "item_text")):
        scanned = scanned.unionByName(docs.join(F.broadcast(block), F.contains("text", "item_text")).select("item_id", "doc_id"))
    widths = sorted(r[0] for r in key.where("__n > 0").select("__n").distinct().collect())
    if not widths:
        return scanned.distinct()
    w = F.col("__w")

    def grams_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(w, i, n), " ")))

    # Texts are split once and stay behind; only hashes are joined.
    exploded = docs.select("doc_id", words(F.col("text")).alias("__w")).select("doc_id", F.explode(F.array_distinct(F.concat(*map(grams_of, widths)))).alias("__k"))
    found = exploded.join(small(long), "__k").select(F.col("doc_id").alias("__id"), "item_id", "item_text").distinct()
    whole = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id"))).where(F.contains("text", "item_text"))
    return whole.select("item_id", "doc_id").unionByName(scanned).distinct()


# Named patterns of a content scan, and file names that are never published.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret": r"(?i)aws_secret_access_key\s*[=:]\s*\S{20,}",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}",
    "api_key": r"(?i)(api[_-]?key|secret|token)\s*[=:]\s*[\"'][A-Za-z0-9/+_-]{24,}[\"']",
    "password": r"(?i)(senha|password|passwd)\s*[=:]\s*[\"'][^\"']{4,}[\"']",
}
FORBIDDEN_NAMES = r"(?i)(\.pem|\.key|\.p12|\.pfx|id_rsa|id_ed25519|\.env.*|usuarios\.json|\.netrc|credentials)$"


def forbidden_files(files: DataFrame, path: str, pattern: str = FORBIDDEN_NAMES) -> DataFrame:
    """Files whose name alone keeps them out, whatever they hold."""
    return files.where(F.element_at(F.split(path, "/"), -1).rlike(pattern))


def ensure_none(findings: DataFrame, what: str) -> None:
    """An error that names a few findings, if there is any."""
    some = findings.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def scan_lines(df: DataFrame, key: str, text: str, patterns: dict[str, str] = SECRET_PATTERNS) -> DataFrame:
    """(key, line number from 1, pattern name) of each line that a pattern matches; untouched texts are passed over first."""
    some = F.lit(False)
    for rx in patterns.values():
        some = some | F.col(text).rlike(rx)
    lines = df.where(some).select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    names = F.filter(F.array(*(F.when(F.col("content").rlike(rx), F.lit(n)) for n, rx in patterns.items())), lambda x: x.isNotNull())
    return lines.select(key, (F.col("line") + 1).alias("line"), F.explode(names).alias("pattern"))


def structural_check(text: Column, ids: int = 3, pairs: int = 4, chars: int = 800) -> Column:
    """Labels of what a card lacks; an empty list passes. Counted are whole node markers and question-answer pairs."""
    n_ids = F.regexp_count(text, F.lit(r"<<ID=[^|>]+\|DOC=[^|>]+\|TYPE=[^|>]+\|PARENT=[^>]+>>"))
    n_pairs = F.regexp_count(text, F.lit(r"(?s)\[PERGUNTA\].*?\[RESPOSTA\]"))
    return F.array_compact(F.array(F.when(n_ids < ids, F.lit("ids")), F.when(n_pairs < pairs, F.lit("pairs")), F.when(F.length(text) < chars, F.lit("short"))))


def card_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, doc, type, parent) of each node marker of a card."""
    rx = r"<<ID=([^|>]+)\|DOC=([^|>]+)\|TYPE=([^|>]+)(?:\|PARENT=([^|>]+))?>>"
    zipped = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(rx), F.lit(i)).alias(n) for i, n in ((1, "id"), (2, "doc"), (3, "type"), (4, "parent"))))
    return df.select(key, F.explode(zipped).alias("n")).select(key, "n.id", "n.doc", "n.type", F.nullif(F.col("n.parent"), F.lit("")).alias("parent"))


def precedent_index(repercussion: DataFrame, binding: DataFrame, plain: DataFrame, themes: DataFrame) -> DataFrame:
    """(court, type, number) of all that may be cited, from tables of a ``number``: a citation of a summary may name a binding one."""
    def named(df: DataFrame, court: str, kind: str) -> DataFrame:
        return df.select(F.lit(court).alias("court"), F.lit(kind).alias("type"), F.col("number").cast("int").alias("number"))

    parts = [named(repercussion, "STF", "RG"), named(binding, "STF", "SUM"), named(plain, "STF", "SUM"), named(themes, "STJ", "REP"), named(themes, "STJ", "SUM")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def existence_check(cards: DataFrame, key: str, text: str, index: DataFrame) -> DataFrame:
    """Per card: cited precedents and whether all are in the index (court, type, number)."""
    refs = cards.select(key, F.explode_outer(references(F.col(text))).alias("r")).select(key, "r.court", "r.type", F.col("r.number").cast("int").alias("number"))
    joined = refs.join(index.select("court", "type", "number").distinct().withColumn("known", F.lit(True)), ["court", "type", "number"], "left")
    return joined.groupBy(key).agg(F.count("number").alias("n_refs"), F.coalesce(F.bool_and(F.when(F.col("number").isNotNull(), F.coalesce("known", F.lit(False)))), F.lit(True)).alias("all_exist"))


def bullet_sample(text: Column, per_block: int = 2, most: int = 3) -> Column:
    """Claims to check: up to two bullet lines of each citation block (precedents, then norms), the first three in all."""
    blocks = F.concat(*(F.regexp_extract_all(text, F.lit(rf"(?s)\[{name}\](.*?)(?=<<|$)"), F.lit(1)) for name in ("JURISPRUDÊNCIA", "NORMAS INTERPRETADAS")))
    bullets = F.transform(blocks, lambda b: F.slice(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("-")), 1, per_block))
    return F.slice(F.flatten(bullets), 1, most)


def faithful(claims: Column, anchored: Column, least: float = 0.7) -> Column:
    """Whether enough of a card's claims were found anchored (a list of true, false or null beside them); no claim passes."""
    n = F.size(F.filter(anchored, lambda x: F.coalesce(x, F.lit(False))))
    return (F.size(claims) == 0) | (n >= least * F.size(claims))


def first_failing_layer(*ok: Column) -> Column:
    """Number of the first layer that fails; null if all pass. Later layers of a failing row are not looked at."""
    return F.coalesce(*(F.when(~c, F.lit(k)) for k, c in enumerate(ok)))


def verification_report(df: DataFrame, layer: str) -> DataFrame:
    ok = F.col(layer).isNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.try_divide(100 * F.count_if(ok), F.count(F.lit(1))).alias("percent"),
                  *(F.count_if(F.col(layer) == k).alias(f"failed_{k}") for k in (0, 1, 2)))


#: Bytes from which a file is read in pieces; a shorter one is a cell of a row.
WHOLE_BYTES = 128_000_000


def _digests(frames):
    """(path, bytes, n_lines, sha256) of files read in pieces."""
    import hashlib

    import pandas as pd
    from pyarrow import fs

    for pdf in frames:
        rows = []
        for path in pdf["path"]:
            system, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
            digest, size, lines = hashlib.sha256(), 0, 0
            with system.open_input_stream(at, compression=None) as src:
                while piece := src.read(1 << 22):
                    digest.update(piece)
                    size += len(piece)
                    lines += piece.count(b"\n")
            rows.append((path, size, lines if path.endswith(".jsonl") else None, digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "bytes", "n_lines", "sha256"]).astype({"n_lines": "Int64"})


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, bytes, lines (of .jsonl alone) and SHA-256 of every file below a folder.

    A digest takes a file's bytes in order, so a file is one task's; from ``WHOLE_BYTES`` on it is read in pieces, and of any size.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    lines = F.when(F.col("path").endswith(".jsonl"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).cast("long"))
    whole = files.where(F.col("length") < WHOLE_BYTES).select("path", F.length("content").cast("long").alias("bytes"), lines.alias("n_lines"), F.sha2("content", 256).alias("sha256"))
    long = files.where(F.col("length") >= WHOLE_BYTES).select("path")
    return whole.unionByName(long.repartition("path").mapInPandas(_digests, whole.schema))


def verify_manifest(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing (FALTA) or changed (MUDOU)."""
    j = stored.select("path", F.col("sha256").alias("was")).join(found.select("path", F.col("sha256").alias("now")), "path", "left")
    return j.withColumn("state", F.when(F.col("now").isNull(), "FALTA").when(F.col("was") != F.col("now"), "MUDOU")).where("state IS NOT NULL").select("path", "state")


def missing_from(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return stored.select(key).exceptAll(seen.select(key))


def by_top_folder(files: DataFrame, path: str = "path") -> DataFrame:
    """Files, bytes and lines of each top folder; files without one under a dot."""
    top = F.when(F.col(path).contains("/"), F.split(path, "/")[0]).otherwise(".")
    return files.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("n_lines").alias("n_lines"))


def best_name(names: DataFrame, quotas: DataFrame, key: str, text: str, quota: str, least: int = 2) -> DataFrame:
    """For each text, the quota name that holds most of its parts (of three letters or more), ``least`` at the least; the first of equals.

    Texts of the same parts are matched once. Words that a quota shares with a text are met by a join on the parts, so work follows
    matching parts of different texts and not all pairs. Quota names are split on everything but letters and digits; a part must be one of their words.
    """
    parts = F.array_distinct(F.filter(F.split(F.lower(text), r"[.\-:_ ]"), lambda p: (F.length(p) > 2) & (p != "us")))
    words = F.array_distinct(F.filter(F.split(F.lower(quota), r"[^\p{L}\p{N}]+"), lambda p: p != ""))
    named = names.select(F.col(key).alias("k"), F.array_sort(parts).alias("parts"))
    left = named.select("parts").distinct().select("parts", F.explode("parts").alias("part"))
    right = quotas.select(F.col(quota).alias("q"), F.explode(words).alias("part")).distinct()
    common = left.join(right, "part").groupBy("parts", "q").agg(F.count(F.lit(1)).cast("int").alias("common")).where(F.col("common") >= least)
    order = lambda: F.min(F.struct((-F.col("common")).alias("c"), "q"))
    best = materialize(common.groupBy("parts").agg(order().alias("b")).select("parts", (-F.col("b.c")).alias("common"), "b.q"), "names")
    found = named.join(small(best), "parts").groupBy("k").agg(order().alias("b"))
    return found.select(F.col("k").alias(key), F.col("b.q").alias(quota), (-F.col("b.c")).alias("common"))


def unmatched_titles(df: DataFrame, classes: DataFrame, title: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their title's class, and the count of rows of each title that has none."""
    named = df.withColumn(title, F.trim(F.coalesce(F.col(title), F.lit(""))))
    known = classes.select(title, kind)
    return named.join(known, title), named.join(known, title, "left_anti").groupBy(title).agg(F.count(F.lit(1)).alias("n"))


def modal_classes(df: DataFrame, title: str, kind: str) -> DataFrame:
    """The class of each title; a title of two classes is an error."""
    classes = df.select(F.trim(F.coalesce(F.col(title), F.lit(""))).alias(title), kind).groupBy(title).agg(F.count_distinct(kind).alias("n"), F.min(kind).alias(kind))
    ensure_none(classes.where("n > 1").select(title), "titles of two classes")
    return classes.select(title, kind)


def block_sizes(items: DataFrame, path: str, lines: str) -> DataFrame:
    """(block, n) of the training files of a manifest: ``sft/bloco_<block>/...train.jsonl``."""
    block = F.regexp_extract(path, r"^sft/bloco_([^/]*)/.*train\.jsonl$", 1)
    return items.where(F.col(path).rlike(r"^sft/bloco_[^/]*/.*train\.jsonl$")).select(block.alias("block"), F.col(lines).alias("n"))
