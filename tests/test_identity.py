"""Receipts and shared setups signed by plain Python: what is intact passes, and every change of the tamper lists is found."""

from __future__ import annotations

import copy
import hashlib
import json

from pyspark.sql import functions as F

from skillcorpus.operators import identity as I
from skillcorpus.sources.receipts import read_receipts, summarize
from tests.test_canonical import plain

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
without = lambda d, *keys: {k: v for k, v in d.items() if k not in keys}
SKILL = {"name": "pr-review", "sha256": sha("pr"), "files": 2, "grade": "A", "gate": "pass", "risk": "low"}
RESULT = {
    "runStatus": "complete", "evidenceStatus": "verified-here", "experimentOutcome": "improved", "goalPassed": True, "baselinePassRate": 33.333, "proposedPassRate": 100.0, "liftPoints": 66.667, "baselineAvgTokens": 100.0, "proposedAvgTokens": 90.0,
    "tokenDeltaPct": -10.0, "baselineAvgDurationMs": 10.0, "proposedAvgDurationMs": 10.5, "durationDeltaPct": 5.0,
}


def receipt(n=0, **changes):
    r = {
        "protocolVersion": "p", "receiptId": "", "invocationId": f"invocation-{n}", "startedAt": "2026-01-01T00:00:00Z", "completedAt": "2026-01-01T00:01:00Z", "attestation": "local-self-attested", "providerKind": "real",
        "suite": {"sha256": sha("s"), "verifierSha256": sha("v"), "goalSha256": sha("g"), "title": "Üb \"x\"\n", "taskIds": ["t1"], "goalPassRate": 0.8}, "setups": {"baseline": {"sha256": "", "orderedSkills": []}, "proposed": {"sha256": "", "orderedSkills": [SKILL]}},
        "environment": {"sha256": "", "adapter": "a", "runnerVersion": "r", "providerOrigin": "https://x", "model": "m", "node": "n", "os": "o", "arch": "z", "temperature": 0.2, "maxTokens": 5, "timeoutMs": 1000, "trials": 3, "seeds": [1, 2, 3]},
        "observations": [{"taskId": "t1", "seed": 1, "arm": "baseline", "status": "ok", "pass": False, "tokens": 100.5, "durationMs": 10.0, "suiteSha256": sha("s"), "environmentSha256": "e", "setupSha256": "b"}, {"taskId": "t1", "seed": 1, "arm": "proposed", "status": "provider-error", "pass": False, "tokens": 0.0, "durationMs": 1e-7, "suiteSha256": sha("s"), "environmentSha256": "e", "setupSha256": "b", "errorCode": "provider-error"}],
        "result": dict(RESULT), "limitations": ["Local."], "integrity": {"algorithm": "sha256", "payloadSha256": ""},
    } | changes
    for arm in ("baseline", "proposed"):
        r["setups"][arm]["sha256"] = sha(plain(r["setups"][arm]["orderedSkills"]))
    r["environment"]["sha256"] = sha(plain(without(r["environment"], "sha256")))
    r["receiptId"] = "vr_" + sha(plain({"invocationId": r["invocationId"], "completedAt": r["completedAt"], "suite": r["suite"]["sha256"], "baseline": r["setups"]["baseline"]["sha256"], "proposed": r["setups"]["proposed"]["sha256"], "environment": r["environment"]["sha256"]}))[:24]
    r["integrity"]["payloadSha256"] = sha(plain(without(r, "integrity")))
    return copy.deepcopy(r)


def changed(record, *changes):
    out = copy.deepcopy(record)
    for path, value in changes:
        *way, last = path.split(".")
        at = out
        for k in way:
            at = at[int(k)] if isinstance(at, list) else at[k]
        if value is ...:
            del at[last]
        else:
            at[int(last) if isinstance(at, list) else last] = value
    return out


def test_receipts(spark):
    r = receipt()
    cases = [(r, []), (receipt(1, result=RESULT | {"goalPassed": "unknown"}), []), (changed(r, ("suite.title", "x")), ["payload_sha"]), (changed(r, ("receiptId", "vr_0")), ["receipt_id", "payload_sha"]), (changed(r, ("invocationId", "other")), ["receipt_id", "payload_sha"])]
    cases += [(changed(r, ("environment.model", "x")), ["environment_sha", "payload_sha"]), (changed(r, ("setups.proposed.orderedSkills.0.files", 3)), ["proposed_sha", "payload_sha"]), (changed(r, ("result.goalPassed", False)), ["payload_sha"]), (changed(r, ("observations.0.tokens", 100.25)), ["payload_sha"])]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "k long, t string").select("k", F.from_json("t", I.schema(I.RECEIPT)).alias("r"))
    got = {x.k: x.e for x in df.select("k", I.receipt_tampered(F.col("r")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_files_of_receipts(spark, tmp_path):
    """A file each: intact ones, a copy under another name, a broken one, no object, one that was changed, and an empty one."""
    r = receipt()
    files = {"a": json.dumps(r), "b": json.dumps(receipt(1, providerKind="simulated"), indent=1), "c": json.dumps(r), "d": '{"receiptId": ', "e": "[1]", "f": json.dumps(changed(r, ("suite.title", "x"))), "g": json.dumps(receipt(2, result=RESULT | {"goalPassed": False})), "h": " "}
    for k, v in files.items():
        (tmp_path / f"{k}.json").write_text(v)
    rows = read_receipts(spark, str(tmp_path))
    assert {x.file[-6]: x.valid for x in rows.collect()} == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": False, "g": True}
    s = summarize(rows, skipped=4).first()
    assert (s.real, s.successes, s.simulations, s.invalid, s.duplicates, s.skipped, s.rate) == (2, 1, 1, 3, 1, 4, 50.0)


def artifact(name):
    return {
        "name": name, "artifactId": f"sa_{sha(name)[:32]}", "verificationSha256": sha(name), "bundleSha256": sha("b"), "payloadSha256": sha("p"), "files": 2, "totalBytes": 9, "source": {"repository": "a/b", "commit": "0" * 40, "rootTreeOid": "1" * 40, "rootPath": f"s/{name}", "pinnedUrl": f"https://github.com/a/b/tree/{'0' * 40}/s/{name}"},
        "assessment": {"grade": "A", "gate": "pass", "risk": "low", "rubricVersion": "r", "vector": "SMV:2.0", "uninterpretedFiles": 0}, "license": {"spdx": "MIT", "sha256": sha("l"), "installPath": "L"}, "evidence": "inspected-exact-version", "limitations": ["x"],
    }


def capsule(names=("one", "two"), **changes):
    arts = [artifact(n) for n in names]
    setup = [{"name": a["name"], "sha256": a["verificationSha256"], "files": a["files"], **{k: a["assessment"][k] for k in ("grade", "gate", "risk")}} for a in arts]
    c = {
        "protocolVersion": "c1", "capsuleId": "", "createdAt": "2026-01-01T00:01:00Z", "setup": {"catalogProtocolVersion": "v2", "cliVersion": "1", "catalogSha256": sha("cat"), "setupSha256": sha(plain(setup)), "orderedArtifacts": arts},
        "senderEvidence": {"verificationProtocolVersion": "p", "sourceReceiptPayloadSha256": sha("r"), "suiteSha256": sha("s"), "verifierSha256": sha("v"), "goalSha256": sha("g"), "environmentSha256": sha("e"), "attestation": "local-self-attested", "authentication": "none", "localValidation": "x", "result": dict(RESULT)},
        "replay": {"setup": "exact-catalog-artifacts", "experiment": "unavailable-private-suite", "artifactIds": [a["artifactId"] for a in arts]}, "limitations": ["x"], "integrity": {"algorithm": "sha256", "payloadSha256": ""},
    } | changes
    return signed(c)


def signed(c):
    c = copy.deepcopy(c)
    c["capsuleId"] = "sc_" + sha(plain(without(c, "capsuleId", "integrity")))[:32]
    c["integrity"]["payloadSha256"] = sha(plain(without(c, "integrity")))
    return c


def test_shared_setups(spark):
    c = capsule()
    mismatch = ["capsuleId does not match canonical content", "capsule integrity does not match canonical content"]
    cases = [
        (c, [], True), (changed(c, ("extra", 1)), ["capsule contains missing or unknown top-level fields"], False), (changed(c, ("setup.orderedArtifacts.0.source.branch", "main")), ["setup projection is invalid"], False), (changed(c, ("replay.artifactIds", ...)), ["replay state is invalid"], False),
        (changed(c, ("limitations", ["y"])), mismatch, True), (signed(changed(c, ("replay.artifactIds", c["replay"]["artifactIds"][::-1]))), ["replay artifact order differs from setup order"], True), (signed(changed(c, ("senderEvidence.result.liftPoints", 60.0))), ["sender evidence projection is invalid"], False),
        (signed(changed(c, ("senderEvidence.result.goalPassed", "unknown"))), ["sender evidence projection is invalid"], False), (signed(changed(c, ("setup.setupSha256", sha("z")))), ["setup identity differs from the ordered artifact bridge"], True), (capsule(("one", "one")), ["capsule artifacts must be unique"], True),
        (signed(changed(c, ("setup.catalogSha256", sha("older")))), [], False), (capsule(("one", "absent")), ["artifact is unavailable in this catalog: absent"], True), (signed(changed(c, ("setup.orderedArtifacts.1.totalBytes", 10))), ["artifact projection differs from this catalog: two"], True),
    ]
    rows = spark.createDataFrame([(i, json.dumps(x[0])) for i, x in enumerate(cases)] + [(90, "[1]"), (91, "nonsense"), (92, None)], "k long, capsule string")
    index = spark.createDataFrame([(n, json.dumps(artifact(n))) for n in ("one", "two")], "name string, t string").select("name", F.from_json("t", I.schema(I.ARTIFACT)).alias("artifact"))
    found = {r.k: (r.errors, r.compatible) for r in I.audit_capsules(rows, index, {"catalogProtocolVersion": "v2", "cliVersion": "1", "catalogSha256": sha("cat")}).collect()}
    for i, (_, errors, compatible) in enumerate(cases):
        assert found[i] == (errors, compatible), i
    assert all(found[k][0] and not found[k][1] for k in (90, 91, 92))
