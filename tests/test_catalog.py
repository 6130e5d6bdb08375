"""Payloads of artifacts signed by plain Python, every tamper case of theirs, coverage of manifests, and order across spans."""

from __future__ import annotations

import base64
import copy
import hashlib
import json

from pyspark.sql import functions as F

from skillcorpus.functions.canonical import canonical
from skillcorpus.operators import catalog as K
from tests.test_canonical import plain

CONTENTS = {"SKILL.md": "# Kit é\n".encode() * 40, "run.sh": b"#!/bin/sh\n", "z/empty.txt": b""}
sha = lambda b: hashlib.sha256(b).hexdigest()
b64 = lambda b: base64.b64encode(b).decode()


def artifact(n):
    files, given = [], []
    for i, (path, content) in enumerate(CONTENTS.items()):
        blob = hashlib.sha1 if i else hashlib.sha256  # git ids of both kinds
        files.append({"path": path, "sourcePath": f"s/{path}", "gitMode": "100755" if path == "run.sh" else "100644", "gitBlobOid": blob(b"blob %d\0" % len(content) + content).hexdigest(), "size": len(content), "sha256": sha(content)})
        given.append({"path": path, "mode": 448 if path == "run.sh" else 384, "size": len(content), "sha256": sha(content), "base64": b64(content)})
    license_ = {"path": "LICENSE", "sha256": sha(b"MIT"), "base64": b64(b"MIT")}
    a = {"artifactId": f"sa_{n}", "name": f"kit-{n}", "payloadSha256": "", "license": {"sourcePath": "LICENSE", "sha256": sha(b"MIT")}, "files": files}
    p = {"protocolVersion": "p1", "artifactId": f"sa_{n}", "name": f"kit-{n}", "payloadSha256": "", "license": license_, "files": given}
    return sign(a, p)


def sign(a, p):
    a, p = copy.deepcopy(a), copy.deepcopy(p)
    a["payloadSha256"] = p["payloadSha256"] = sha(plain({k: p[k] for k in ("protocolVersion", "name", "files", "license")}).encode())
    return a, p


def test_payloads(spark):
    digest, first = "payload digest mismatch", "payload file mismatch: SKILL.md"
    cases = []

    def case(errors, change, signed=False):
        a, p = artifact(len(cases))
        change(a, p)
        cases.append((*(sign(a, p) if signed else (a, p)), errors))

    case([], lambda a, p: None)
    case([digest, first], lambda a, p: p["files"][0].update(base64=b64(b"tampered")))
    case([first], lambda a, p: p["files"][0].update(base64=b64(b"tampered")), signed=True)
    case([digest, "payload file coverage mismatch", "payload file mismatch: z/empty.txt"], lambda a, p: p["files"].pop())
    case([first], lambda a, p: p["files"][0].update(mode=448), signed=True)
    case([first], lambda a, p: p["files"][0].update(base64=p["files"][0]["base64"] + "=="), signed=True)
    case([first], lambda a, p: a["files"][0].update(gitBlobOid="0" * 40))
    case([first], lambda a, p: p["files"].reverse(), signed=True)
    case(["license payload mismatch"], lambda a, p: p["license"].update(base64=b64(b"GPL")), signed=True)
    case(["payload identity mismatch"], lambda a, p: p.update(name="kit-x"), signed=True)
    case(["payload identity mismatch", digest], lambda a, p: a.update(payloadSha256="0" * 64) or p.update(payloadSha256="1" * 64))
    rows = lambda i, ddl: spark.createDataFrame([(json.dumps(c[i]),) for c in cases], "t string").select(F.from_json("t", ddl).alias("x")).select("x.*")
    artifacts = rows(0, f"artifactId string, name string, payloadSha256 string, license struct<sourcePath string, sha256 string>, files array<struct<{K.FILE}>>")
    payloads = rows(1, f"protocolVersion string, artifactId string, name string, payloadSha256 string, license struct<{K.PAYLOAD_LICENSE}>, files array<struct<{K.PAYLOAD_FILE}>>")
    got = {r.artifactId: r.errors for r in K.payload_errors(artifacts, payloads).collect()}
    assert [got[f"sa_{i}"] for i in range(len(cases))] == [c[2] for c in cases]
    alone = K.payload_errors(artifacts.limit(1), payloads.filter("false")).first()
    assert alone.errors[0] == "payload identity mismatch" and alone.errors[-1] == "payload file mismatch: SKILL.md"


def test_manifests_and_sources_cover_each_other(spark):
    files = spark.createDataFrame([("a", "x", "100644", 1, "s"), ("a", "y", "100755", 1, "s"), ("a", "w", "100644", 1, "s"), ("b", "x", "100644", 2, "s")], "artifactId string, path string, gitMode string, size int, sha256 string")
    manifests = spark.createDataFrame([("a", "x", 384, 1, "s"), ("a", "y", 384, 1, "s"), ("a", "z", 384, 1, "s"), ("b", "x", 384, 3, "s")], "artifactId string, path string, mode int, size int, sha256 string")
    assert {tuple(r) for r in K.manifest_coverage(files, manifests).collect()} == {("a", "y", "differs"), ("a", "z", "no source"), ("a", "w", "no entry"), ("b", "x", "differs")}


def test_order_across_spans(spark):
    names = ["a", "b", "b", "a", "c", "d", "c", "e", "f", "a", "g"]
    rows = spark.createDataFrame([(i * 3, n) for i, n in enumerate(names)], "ord long, name string")
    want = {(i * 3, n) for i, n in enumerate(names) if i and n < names[i - 1]}
    for span in (1, 4, 7, 1000):
        assert {tuple(r) for r in K.unsorted(rows, span).collect()} == want


def test_digest_of_a_column_of_nulls(spark):
    from pyspark.sql import types as T

    assert spark.createDataFrame([(None,)], "s string").select(canonical(F.col("s"), T.StringType())).first()[0] is None
