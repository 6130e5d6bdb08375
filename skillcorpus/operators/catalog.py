"""Manifests, digests, the artifact index and shared setups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcorpus.functions.canonical import digest


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """``bundle_id, path, change``: entries that are added, removed, changed or only of another mode, source against target."""
    a = source.select("bundle_id", "path", F.col("mode").alias("mode_a"), F.col("sha256").alias("sha_a"), F.lit(True).alias("in_a"))
    b = target.select("bundle_id", "path", F.col("mode").alias("mode_b"), F.col("sha256").alias("sha_b"), F.lit(True).alias("in_b"))
    rows = a.join(b, ["bundle_id", "path"], "full")
    change = F.when(F.col("in_a").isNull(), "removed").when(F.col("in_b").isNull(), "added").when(F.col("sha_a") != F.col("sha_b"), "changed").when(F.col("mode_a") != F.col("mode_b"), "mode")
    return rows.select("bundle_id", "path", change.alias("change")).filter("change is not null")


def canonical(entries: DataFrame) -> DataFrame:
    """``bundle_id, files, total_bytes, text``: manifests as canonical JSON (keys in order, no spaces, entries by path).

    A bundle has few entries (an installable one 200 at most), so they are gathered by bundle.
    """
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    entry = F.concat(F.lit('{"kind":"file","mode":'), F.col("mode"), F.lit(',"path":'), text("path"), F.lit(',"sha256":"'), F.col("sha256"), F.lit('","size":'), F.col("size"), F.lit("}"))
    rows = entries.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_bytes"), F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]).alias("all"))
    whole = F.concat(F.lit('{"entries":['), F.array_join("all", ","), F.lit('],"files":'), F.col("files"), F.lit(',"rootMode":448,"totalBytes":'), F.col("total_bytes"), F.lit(',"uninterpretedFiles":[]}'))
    return rows.select("bundle_id", "files", "total_bytes", whole.alias("text"))


def bundle_digests(entries: DataFrame) -> DataFrame:
    """``bundle_id, files, total_bytes, bundle_sha256``."""
    return canonical(entries).select("bundle_id", "files", "total_bytes", F.sha2("text", 256).alias("bundle_sha256"))


def index_errors(entries: DataFrame) -> DataFrame:
    """Adds ``errors`` to index entries ``name, source_url, status, reason``: malformed names and URLs, duplicates, unknown states."""
    # Reasons for an entry that is only a link.
    reasons = ["not-in-v2.1-pilot", "source-policy-mismatch", "unsupported-tree", "bounds-failed", "full-gate-failed", "license-policy-failed"]
    bad = [
        (~F.rlike("name", F.lit(r"^[a-z0-9]+(?:-[a-z0-9]+)*\z")), "name"), (F.count(F.lit(1)).over(Window.partitionBy("name")) > 1, "duplicate"),
        (~F.rlike("source_url", F.lit(r"^https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/blob/[^/]+/.+/SKILL\.md\z")), "url"),
        (~F.col("status").isin("pilot-ready", "link-only") | ((F.col("status") == "link-only") & ~F.coalesce(F.col("reason").isin(reasons), F.lit(False))), "status"),
    ]
    return entries.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in bad])))


def base64_text(content: Column) -> Column:
    """The Base64 text of bytes, in one line."""
    return F.regexp_replace(F.base64(content), r"[\r\n]+", "")


def git_blob(content: Column, digits: Column) -> Column:
    """The object id that git gives to a file of these bytes: of 40 digits by SHA-1, of 64 by SHA-256, as ``digits`` has."""
    whole = F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")).cast("binary"), content)
    return F.when(F.length(digits) == 64, F.sha2(whole, 256)).otherwise(F.sha1(whole))


FILE = "path string, sourcePath string, gitMode string, gitBlobOid string, size bigint, sha256 string"
PAYLOAD_FILE = "path string, mode bigint, size bigint, sha256 string, base64 string"
PAYLOAD_LICENSE = "path string, sha256 string, base64 string"


def payload_sha(protocol: Column, name: Column, files: Column, license_: Column) -> Column:
    """The digest that a payload's content gives."""
    kind = T.StructType.fromDDL(f"protocolVersion string, name string, files array<struct<{PAYLOAD_FILE}>>, license struct<{PAYLOAD_LICENSE}>")
    return digest(F.struct(protocol.alias("protocolVersion"), name.alias("name"), files.alias("files"), license_.alias("license")), kind)


def payload_errors(artifacts: DataFrame, payloads: DataFrame, max_license: int = 1 << 20, key: str = "artifactId") -> DataFrame:
    """``artifactId, name, errors``: what is wrong with each artifact's payload, in order; an artifact without one is in error, too.

    ``artifacts`` has ``artifactId, name, payloadSha256, license`` (``sourcePath, sha256``) and ``files`` (``FILE``), ``payloads`` ``protocolVersion, artifactId, name, payloadSha256, license, files``. Bytes are decoded, and must be what the Base64
    text says in its only form, of the size, digest and git object id that are declared. Files of both sides are laid side by side by place, so one that is there on one side only is found. Ids are unique on both sides.
    Both sides meet once, by ``key``: another column that tells artifacts apart, kept in the result, where both are dealt by it already.
    """
    held = [key] if key != "artifactId" else []
    a = artifacts.select(*[F.col(c).alias(f"a_{c}") for c in ("artifactId", "name", "payloadSha256", "license", "files", *held)])
    p = payloads.select(*[F.col(c).alias(f"p_{c}") for c in ("artifactId", "protocolVersion", "name", "payloadSha256", "license", "files", *held)])
    rows = a.join(p, F.col(f"a_{key}") == F.col(f"p_{key}"), "left")
    known = (F.col("p_artifactId") == F.col("a_artifactId")) & (F.col("p_name") == F.col("a_name")) & (F.col("p_payloadSha256") == F.col("a_payloadSha256"))
    own = F.try_to_binary(F.col("p_license.base64"), F.lit("base64"))
    license_ = (base64_text(own) == F.col("p_license.base64")) & (F.octet_length(own) <= max_license) & (F.col("p_license.path") == F.col("a_license.sourcePath")) & (F.col("p_license.sha256") == F.col("a_license.sha256")) & (F.sha2(own, 256) == F.col("p_license.sha256"))

    def same(f: Column, g: Column) -> Column:
        content = F.try_to_binary(g["base64"], F.lit("base64"))
        return (
            (base64_text(content) == g["base64"]) & (g["path"] == f["path"]) & (g["mode"] == F.when(f["gitMode"] == "100755", 448).otherwise(384)) & (g["size"] == f["size"]) & (g["sha256"] == f["sha256"]) & (F.octet_length(content) == g["size"])
            & (F.sha2(content, 256) == g["sha256"]) & (git_blob(content, f["gitBlobOid"]) == f["gitBlobOid"])
        )

    none = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    both = F.arrays_zip(none("a_files"), none("p_files"))
    wrong = F.filter(both, lambda z: ~F.coalesce(same(z["a_files"], z["p_files"]), F.lit(False)))
    found = rows.select(
        F.col("a_artifactId").alias("artifactId"), F.col("a_name").alias("name"), *[F.col(f"a_{c}").alias(c) for c in held], known.alias("known"),
        (payload_sha(F.col("p_protocolVersion"), F.col("p_name"), F.col("p_files"), F.col("p_license")) == F.col("p_payloadSha256")).alias("digested"), license_.alias("licensed"), (F.size("a_files") == F.size("p_files")).alias("covered"),
        F.get(F.transform(wrong, lambda z: F.struct(F.coalesce(z["a_files"]["path"], z["p_files"]["path"]).alias("path"))), F.lit(0)).alias("first"),
    )
    checks = [(F.col("known"), "payload identity mismatch"), (F.col("digested"), "payload digest mismatch"), (F.col("licensed"), "license payload mismatch"), (F.col("covered"), "payload file coverage mismatch")]
    listed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in checks] + [F.when(F.col("first").isNotNull(), F.concat(F.lit("payload file mismatch: "), F.col("first.path")))]
    return found.select("artifactId", "name", *held, F.array_compact(F.array(*listed)).alias("errors"))


def manifest_coverage(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``artifactId, path, fault``: where the source files of artifacts (``artifactId, path, gitMode, size, sha256``) and the entries of their manifests (``artifactId, path, mode, size, sha256``) do not cover each other: ``no source``, ``no entry`` or ``differs``."""
    a = files.select("artifactId", "path", F.struct(F.when(F.col("gitMode") == "100755", 448).otherwise(384).alias("mode"), F.col("size").cast("long").alias("size"), "sha256").alias("s"))
    b = manifests.select("artifactId", "path", F.struct(F.col("mode").cast("int").alias("mode"), F.col("size").cast("long").alias("size"), "sha256").alias("m"))
    fault = F.when(F.col("s").isNull(), "no source").when(F.col("m").isNull(), "no entry").when(F.col("s") != F.col("m"), "differs")
    return a.join(b, ["artifactId", "path"], "full").select("artifactId", "path", fault.alias("fault")).filter("fault is not null")


def unsorted(entries: DataFrame, span: int = 100_000) -> DataFrame:
    """The rows of an index (``ord, name``) whose name is less than that of the row before, in order of ``ord``.

    Rows are compared within spans of ``ord``, each in a task of its own, and the first of a span with the last of the span before it that has rows: those are as few as spans.
    """
    rows = entries.withColumn("__span", F.expr(f"ord div {span}"))
    before = F.lag("name").over(Window.partitionBy("__span").orderBy("ord"))
    ends = rows.groupBy("__span").agg(F.max_by("name", "ord").alias("__last"))
    last = ends.withColumn("__before", F.lag("__last").over(Window.orderBy("__span"))).select("__span", "__before")
    return rows.withColumn("__mine", before).join(last, "__span").filter(F.col("name") < F.coalesce("__mine", "__before")).select(*entries.columns)


def install_gate(entries: DataFrame, names: DataFrame, target: DataFrame, max_files: int = 200, max_total: int = 20 << 20, max_file: int = 4 << 20, max_depth: int = 8, max_path: int = 240) -> DataFrame:
    """``bundle_id, reasons, action``: why a bundle may not be installed, and whether it would add or replace.

    ``names`` has ``bundle_id, name`` (its folder's), ``declared`` (in its document), ``grade, gate, risk``: both names must be equal, and the bundle graded A or B, passed and of low risk. Two names of
    the batch that differ in case at most collide, and so does a name with one at the ``target`` (``bundle_id, installed``: the name found where it would go) that differs only in case.
    """
    sizes = entries.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.max(F.size(F.split("path", "/"))).alias("depth"), F.max(F.octet_length("path")).alias("longest"))
    rows = sizes.join(names, "bundle_id").withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy(F.lower("name")))).join(target, "bundle_id", "left")
    trusted = F.col("grade").isin("A", "B") & (F.col("gate") == "pass") & (F.col("risk") == "low")
    bad = [
        (F.col("files") > max_files, "files"), (F.col("total") > max_total, "bytes"), (F.col("largest") > max_file, "file"), (F.col("depth") > max_depth, "depth"), (F.col("longest") > max_path, "path"),
        (~F.rlike("name", F.lit(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,119}\z")) | F.lower("name").isin(".system"), "name"), (~F.col("declared").eqNullSafe(F.col("name")), "identity"), (~F.coalesce(trusted, F.lit(False)), "trust"),
        (F.col("twins") > 1, "collision"), (F.coalesce((F.col("installed") != F.col("name")) & (F.lower("installed") == F.lower("name")), F.lit(False)), "target"),
    ]
    return rows.select("bundle_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in bad])), "|").alias("reasons"), F.when(F.col("installed") == F.col("name"), "replace").otherwise("add").alias("action"))
