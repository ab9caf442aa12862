import pytest
from pyspark.sql import functions as F

from paytrail.operators import adjudicate, generate, store
from tests.test_detectors import edges

CANDS = "candidate_id string, pattern_type string, refs array<string>, n long, confidence double, attributes string"


def candidates(spark):
    rows = [("c1", "cycle", ["T0000"], 1, 0.8, "{}"), ("c2", "fan_in", ["T0001"], 1, 0.5, "{}"), ("c3", "fan_out", ["T0000"], 1, 0.1, "{}"), ("c4", "bipartite", ["T0001"], 1, 0.99, "{}")]
    law = spark.createDataFrame([("cycle", "law:0000000000000001"), ("fan_in", "law:0000000000000001"), ("fan_out", "law:0000000000000002"), ("bipartite", None)], "pattern_type string, chunk_id string")
    hints = spark.createDataFrame([("cycle", f"hint:{r:016x}", r) for r in range(1, 9)], "pattern_type string, chunk_id string, rank int")
    return adjudicate.bundles(spark.createDataFrame(rows, CANDS), law, hints)


def test_loops_accept_or_leave_in_doubt(spark):
    rows = candidates(spark)
    assert {r.candidate_id: len(r.shown) for r in rows.collect()} == {"c1": 6, "c2": 1, "c3": 1, "c4": 0}
    out = {r.candidate_id: r for r in adjudicate.adjudicate(rows).collect()}
    assert {k: (r.status, r.loops) for k, r in out.items()} == {"c1": ("pending_review", 0), "c2": ("pending_review", 2), "c3": ("needs_review", 2), "c4": ("needs_review", 2)}
    assert out["c3"].notes.startswith("below") and out["c4"].notes == "no obligation resolved" and out["c1"].notes is None


def test_a_draft_that_invents_fails_the_gate(spark):
    def liar(rows, loop):
        return adjudicate.plain_draft(rows, loop).withColumn("narrative", F.lit("see ABC12345678 and fake:0123456789abcdef"))

    out = adjudicate.adjudicate(candidates(spark), draft=liar, judge=lambda r, k: r.withColumn("judged", F.lit(1.0))).collect()
    assert {r.status for r in out} == {"needs_review"} and not any(r.faithful for r in out)
    assert out[0].bad_ids == ["fake:0123456789abcdef"] and out[0].bad_refs == ["ABC12345678"]


def test_report_of_a_clean_and_of_a_dirty_batch(spark):
    e = edges(spark, [("a", "b", 10, 0), ("b", "c", 9, 1)])
    dirty = adjudicate.adjudicate(candidates(spark))
    r = adjudicate.assemble(dirty, e).first()
    assert (r.risk_rating, r.findings, r.needs_review, r.period, r.cycle, r.clean) == ("medium", 4, 2, "2024-01", 1, False)
    assert adjudicate.broken_invariants(dirty, e).count() == 0
    assert adjudicate.assemble(dirty.limit(0), e).first().risk_rating == "none"
    names = [n for n, _ in adjudicate.stages(e, lambda x: candidates(spark).limit(0), lambda raw: raw.withColumn("kept", F.lit(True)), lambda k: k)]
    assert names == ["detected", "reconciled", "report"]


def finding(spark, status="pending_review"):
    return spark.createDataFrame([("f1", "r1", "c1", "cycle", "high", 0.9, status, 1)], "finding_id string, report_id string, candidate_id string, pattern_type string, risk_level string, confidence double, status string, ordinal int")


def report(spark, body):
    return spark.createDataFrame([("r1", "run", "2024-01", "high", False, body)], "report_id string, run_id string, period string, risk_rating string, clean boolean, report_json string").withColumn("generated_at", F.current_timestamp())


def test_store_keeps_reports_and_folds_reviews(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.listing().count() == 0
    s.save(report(spark, "first"), finding(spark))
    s.save(report(spark, "second"), finding(spark))
    assert [r.report_json for r in s.read("reports").collect()] == ["first"] and s.findings().count() == 1
    with pytest.raises(store.InvalidTransition):
        s.review("f1", "approve", "ann")
    assert s.review("f1", "escalate", "ann") == "escalated" and s.review("f1", "approve", "bo") == "approved"
    with pytest.raises(store.InvalidTransition):
        s.review("f1", "clear", "cy")
    with pytest.raises(KeyError):
        s.review("f9", "clear", "cy")
    assert s.findings().first().status == "approved" and s.read("reviews").count() == 2
    row = s.listing("2024-01").first()
    assert (row.findings, row.needs_review) == (1, 0) and s.listing("2023-01").count() == 0


@pytest.mark.parametrize("broken", ["findings", "reports", "commits"])
def test_a_save_that_fails_half_way_shows_nothing_of_itself(spark, tmp_path, monkeypatch, broken):
    s, append = store.Store(spark, str(tmp_path)), store.Store.append
    two = finding(spark).unionByName(finding(spark).withColumns({"finding_id": F.lit("f2"), "status": F.lit("needs_review")}))

    def failing(self, name, rows):
        if name == broken:
            raise OSError("disk full")
        append(self, name, rows)

    seen = lambda: (sorted(r.finding_id for r in s.findings().collect()), [(r.report_id, r.findings, r.needs_review) for r in s.listing().collect()])
    for before, rows in (([], two), (["f1", "f2"], finding(spark))):
        monkeypatch.setattr(store.Store, "append", failing)
        with pytest.raises(OSError):
            s.save(report(spark, "text"), rows)
        assert seen() == (before, [("r1", 2, 1)] if before else [])
        monkeypatch.setattr(store.Store, "append", append)
        s.save(report(spark, "text"), two if not before else rows)
    # findings are written anew, so one that is gone is gone; the report keeps its first text
    assert seen() == (["f1"], [("r1", 1, 0)]) and [r.report_json for r in s.reports().collect()] == ["text"]
    own, findings, history = s.report("r1")
    s.review("f1", "escalate", "ann")
    assert (own.count(), [r.finding_id for r in findings.collect()]) == (1, ["f1"]) and [r.action for r in s.report("r1")[2].collect()] == ["escalate"] and "review_id" in history.columns


def test_jobs_are_reused_by_digest_unless_they_failed(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.submit("j1", "b", "d1") == "j1" and s.submit("j2", "b", "d1") == "j1"
    s.finish("j1", error="boom")
    assert s.submit("j3", "b", "d1") == "j3"
    s.finish("j3", report_id="r1")
    assert s.submit("j4", "b", "d1") == "j3" and {r.job_id: r.status for r in s.jobs().collect()} == {"j1": "failed", "j3": "complete"}


def test_retry_gives_up_after_its_attempts():
    calls = []

    def fails():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        store.with_retry(fails, 3, 0)
    assert len(calls) == 3


def test_codes_and_references(spark):
    df = spark.createDataFrame([("UK",), ("Germany",)], "name string")
    assert [r.c for r in df.select(generate.iso(F.col("name"), generate.COUNTRIES).alias("c")).collect()] == ["GB", "DE"]
    with pytest.raises(Exception, match="no code for"):
        spark.createDataFrame([("Nowhere",)], "name string").select(generate.iso(F.col("name"), generate.COUNTRIES)).collect()
    out = generate.mint_references(edges(spark, [("a", "b", 1, 0), ("a", "b", 1, 0.5), ("a", "b", 1, 1)]), ["us"]).orderBy("us").collect()
    assert [r.reference for r in out] == ["FGO24010100001", "FGO24010100002", "FGO24010200001"]


def test_chunk_table_guards_its_backend(spark, tmp_path):
    t = store.ChunkTable(spark, str(tmp_path / "chunks"), "hashed", 2)
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, tier string, embedding array<float>")
    with pytest.raises(FileNotFoundError):
        t.read()
    t.upsert(rows(("a", "statute", [1.0, 0.0]), ("b", "guidance", [0.0, 1.0])))
    t.upsert(rows(("a", "regulation", [1.0, 1.0])))
    assert {r.chunk_id: r.tier for r in t.read().collect()} == {"a": "regulation", "b": "guidance"} and t.get(["b", "x"]).count() == 1
    assert {(r.tier, r.n) for r in t.counts("tier").collect()} == {("regulation", 1), ("guidance", 1), (None, 2)}
    with pytest.raises(store.BackendMismatch):
        t.upsert(rows(("c", "statute", [1.0])))
    with pytest.raises(store.BackendMismatch):
        store.ChunkTable(spark, t.path, "other", 2).read()


def test_files(spark, tmp_path):
    from paytrail.sources import files

    head = "Time,Date,Sender_account,Receiver_account,Amount,Payment_currency,Received_currency,Sender_bank_location,Receiver_bank_location,Payment_type,Is_laundering,Laundering_type"
    (tmp_path / "t.csv").write_text(head + "\n10:35:19,2024-01-07,1,2,14.50,USD,USD,US,GB,Cash Deposit,0,Normal\n10:35:20,2024-02-07,3,4,x,USD,USD,US,US,ACH,1,Fan_In\n")
    rows = files.read_transactions(spark, str(tmp_path / "t.csv"))
    assert rows.count() == 2 and files.read_transactions(spark, str(tmp_path / "t.csv"), ["2024-01"]).count() == 1
    one = files.as_ledger(rows).orderBy("ts").first()
    assert (str(one.ts), one.payment_kind, str(one.amount)) == ("2024-01-07 10:35:19", "cash_deposit", "14.50")
    (tmp_path / "p.json").write_text('[{"ID": "a", "DocumentID": 1, "PassageID": "1.1", "Passage": "x"}, {"ID": "b", "DocumentID": 1, "PassageID": "1.2", "Passage": null}]')
    assert [r.Passage for r in files.read_passages(spark, str(tmp_path / "p.json")).orderBy("ID").collect()] == ["x", ""]
    (tmp_path / "q.json").write_text('[{"Question": "q", "Passages": [{"DocumentID": 1, "PassageID": "1.1"}, {"DocumentID": 2, "PassageID": "9"}]}]')
    assert files.read_questions(spark, str(tmp_path / "q.json")).count() == 2
    good = spark.createDataFrame([("c1", "text", "statute", "binding", "s", "1", "US", ["x"], None, "1", "f")], files.CHUNK_SCHEMA)
    files.write_chunks(good, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks")).first() == good.first()
    bad = good.unionByName(good.withColumn("authority", F.lit("illustrative")))
    assert {r.problem for r in files.chunk_problems(bad).collect()} == {"repeated", "authority"}
    with pytest.raises(ValueError, match="repeated|authority"):
        files.write_chunks(bad, str(tmp_path / "more"))
    labels = lambda *r: spark.createDataFrame(list(r), "reference string, log_file string")
    files.write_labels(labels(("a", "x"), ("b", "y")), str(tmp_path / "labels"))
    files.write_labels(labels(("c", "x")), str(tmp_path / "labels"))
    assert sorted((r.reference, r.log_file) for r in spark.read.option("header", True).csv(str(tmp_path / "labels")).collect()) == [("b", "y"), ("c", "x")]
    (tmp_path / "m.json").write_text('{"a.txt": {"sha256": "00", "role": "text", "tier": "statute", "authority": "binding"}}')
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().tier == "statute"
