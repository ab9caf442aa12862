import pytest
from pyspark.sql import functions as F

from paytrail.functions import chunks, redact, text
from paytrail.operators import evaluate, report, retrieval
from paytrail.sources import ledger, mt103

GOOD = """{1:F01BANKUS33AXXX0000000000}{2:I103BANKGB22XXXXN}{3:{121:0f1e2d3c-0000-1111-2222-333344445555}}{4:
:20:REF001
:23B:CRED
:32A:240105USD5669,49
:50K:/123
Ann Example
1 Road
:52A:BANKUS33
:57A:BANKGB22
:59:/456
Bo Example
:70:rent
:72:/INS/CASH DEPOSIT 04:22:05
-}"""


def parse(spark, body):
    return mt103.parse_messages(spark.createDataFrame([("f", body)], "file string, text string")).orderBy("ordinal").collect()


def test_a_message_is_read_exactly(spark):
    (r,) = parse(spark, "Statement reference : S1\nMessages in batch   : 1\n\n" + GOOD + "\nfooter\n")
    assert r.reason is None and str(r.amount) == "5669.49" and str(r.ts) == "2024-01-05 04:22:05" and r.instrument == "CASH DEPOSIT"
    assert (r.sender_account, r.sender_name, r.sender_address, r.receiver_name, r.sender_country, r.memo) == ("123", "Ann Example", "1 Road", "Bo Example", "US", "rent") and r.uetr.startswith("0f1e2d3c")


@pytest.mark.parametrize(
    "old,new,reason",
    [
        (":32A:240105USD5669,49\n", "", "missing 32A"), ("5669,49", "5669.49", "amount has a dot"), ("5669,49", "0,00", "amount is not positive"), ("5669,49", "566949", "amount needs one decimal comma"), ("240105", "240631", "no such value date"),
        ("USD5669,49", "USD-5669,49", "32A is not date, currency and amount"), (":20:REF001", ":20:", "no reference"), ("\n-}", "", "not terminated"), ("04:22:05", "25:00:00", "no such time"), ("/123", "/12x", "50K has no account number"), ("BANKGB22\n:59", "B1\n:59", "57A is not a BIC"),
    ],
)
def test_faults_are_refused_with_their_reason(spark, old, new, reason):
    assert parse(spark, GOOD.replace(old, new, 1))[0].reason == reason


def test_later_tags_win_and_an_unclosed_message_ends_at_the_next(spark):
    assert parse(spark, GOOD.replace(":70:rent", ":70:rent\n:70:other"))[0].memo == "other"
    rows = parse(spark, GOOD[:-2] + "\n" + GOOD)
    assert [r.reason for r in rows] == ["not terminated", None]


def test_rescue_is_tried_once_and_counted(spark):
    logs = spark.createDataFrame([("f", "Messages in batch : 2\n" + GOOD + "\n" + GOOD.replace("5669,49", "5669.49").replace("REF001", "REF002"))], "file string, text string")
    good, bad, rep = mt103.ingest(logs)
    assert (good.count(), bad.count(), rep.first().complete) == (1, 1, False)
    fixed = lambda rows: rows.withColumns({"amount": F.lit("5669.49").cast("decimal(18,2)"), "reason": F.lit(None).cast("string")})
    good, bad, rep = mt103.ingest(logs, fixed)
    assert (good.count(), bad.count(), rep.first().rescued, rep.first().complete) == (2, 0, 1, True)
    twice = mt103.ingest(spark.createDataFrame([("f", GOOD + "\n" + GOOD)], "file string, text string"))[2].first()
    assert (twice.parsed, twice.distinct_references) == (2, 1)


def test_logs_of_any_bytes_are_read(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(GOOD.replace("Ann", "Änn").encode("latin-1"))
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(GOOD.encode("utf-8"))
    logs = mt103.read_logs(spark, str(tmp_path))
    assert logs.count() == 2  # an empty file has no row
    assert sorted(r.sender_name for r in mt103.parse_messages(logs).collect()) == ["Ann Example", "Änn Example"]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_byte_ranges_of_a_log_read_like_the_whole(spark, tmp_path, small_splits):
    many = ["Statement reference : S9", "Messages in batch   : 600", ""]
    for i in range(600):
        body = GOOD.replace("REF001", f"R{i:05d}").replace(":70:rent", ":70:" + f"memo {i} {{1:not a start\n" * (i % 5 + 1) + "rent")
        many += [body[:-3] if i % 50 == 7 else body, "between messages"]
    (tmp_path / "a.txt").write_bytes("\n".join(many).encode())
    (tmp_path / "b.txt").write_bytes("\r\n".join(many[3:40]).replace("Ann", "Änn").encode("latin-1"))
    (tmp_path / "c.txt").write_bytes("\r".join(many[3:9]).encode())
    (tmp_path / "d.txt").write_bytes(b"")
    lines = mt103.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    pick = ["ordinal", "reference", "amount", "memo", "sender_name", "reason"]
    name = F.substring_index("file", "/", -1).alias("name")
    rows = lambda logs: sorted(map(tuple, mt103.parse_messages(logs).select(name, *pick, F.rtrim("raw")).collect()), key=str)
    want = rows(mt103.read_logs(spark, str(tmp_path)))
    assert rows(lines) == want and len(want) > 610 and {r[5] for r in want} == {"Ann Example", "Änn Example"}
    heads = {r.file[-5:]: (r.statement, r.declared) for r in mt103.header(lines).collect()}
    assert heads == {"a.txt": ("S9", 600), "b.txt": (None, None), "c.txt": (None, None)}
    good, bad, report = mt103.ingest(lines)
    assert (good.count() + bad.count(), report.first().declared) == (len(want), 600)


def test_masking(spark):
    rows = [("call 020 7946 0958 on 2024-01-05", "call [REDACTED] on 2024-01-05"), ("pay 95000.00 to a@b.co", "pay 95000.00 to [EMAIL]"), ("GB29NWBK60161331926819", "[REDACTED]"), ("room 1234", "room 1234"), ("+44 7700 900123", "[REDACTED]")]
    out = spark.createDataFrame(rows, "raw string, want string").withColumn("got", redact.scrub(F.col("raw")))
    assert all(r.got == r.want for r in out.collect())
    nested = spark.sql("select struct('A1' as sender_account, 'call 12345678' as memo, array('B2') as senders) as s, 'fan_in:A1:0123456789' as candidate_id, 'x' as other")
    r = redact.redact(nested, "p").first()
    assert r.s.sender_account.startswith("ACCT-") and r.s.memo == "call [REDACTED]" and r.s.senders[0].startswith("ACCT-") and r.other == "x" and "A1" not in r.candidate_id
    assert redact.redact(nested, "p").first() == r
    found = spark.sql("""select '{"sink":"C3","senders":"A1,B2","fan":4}' as attributes, 'scatter_gather' as pattern_type, 4 as n, map('sender_account', 'A1', 'kind', 'A1') as m""")
    masked = redact.redact(found, "p").withColumn("shape", evaluate.describe())
    got = masked.first()
    assert not any(x in got.attributes + got.shape for x in ("A1", "B2", "C3")) and "4 accounts" in got.shape and got.attributes.count("ACCT-") == 3
    assert got.m["kind"] == "A1" and got.m["sender_account"].startswith("ACCT-")


def test_pages_and_xml(spark):
    page = '<style>x</style><div id="block-body" class="c"><p>A &amp; B</p><br>C</div><div class="tab-content">z</div>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert df.select(text.html_to_text(F.col("html")).alias("t")).first().t == "A & B\n\nC\n\nz"
    assert df.select(text.html_to_text(text.region(F.col("html"), 'id="block-body"', "tab-content")).alias("t")).first().t == "A & B\n\nC"
    xml = spark.createDataFrame([(1, '<DIV8 N="1010.311"><HEAD>h</HEAD><P>(a) <I>One</I></P><P>(b) Two</P></DIV8>')], "id long, xml string")
    assert [(r.section_ref, r.text) for r in chunks.cfr_sections(xml, "id").collect()] == [("§ 1010.311(a)", "(a) One"), ("§ 1010.311(b)", "(b) Two")]
    odd = spark.createDataFrame([(1, "\ufb01ne\u200b\ttext  here \n\n\n\nend ")], "id long, t string")
    assert odd.select(text.normalize(F.col("t")).alias("t")).first().t == "fine text here\n\nend"


def test_payment_kinds(spark):
    rows = [("Cash  Deposit ", "cash_deposit"), ("CROSS-BORDER", "cross_border"), ("barter", "other"), ("Debit card", "card")]
    out = spark.createDataFrame(rows, "raw string, want string").withColumn("got", ledger.payment_kind(F.col("raw")))
    assert all(r.got == r.want for r in out.collect())


def test_reviews_and_reports(spark):
    acts = [("a", 1, "escalate"), ("a", 2, "approve"), ("a", 3, "clear"), ("b", 1, "approve"), ("b", 2, "clear")]
    out = {r.finding_id: (r.status, r.accepted, r.refused) for r in report.review_fold(spark.createDataFrame(acts, "finding_id string, seq int, action string")).collect()}
    assert out == {"a": ("approved", 2, 1), "b": ("cleared", 1, 1)}
    one, two = (spark.createDataFrame([(i, t)], "report_id string, report_json string") for i, t in (("r", "first"), ("r", "second")))
    assert report.save_report(one, two).count() == 0 and report.save_report(one.limit(0), two).count() == 1


def test_exact_neighbours_over_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    out = retrieval.knn(df, F.col("vec_id") % 10 == 0, 5).collect()
    for q in range(0, 300, 10):
        s = unit @ unit[q]
        s[q] = -9
        assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-s)[:5].tolist()


def test_files_are_audited_once(spark, tmp_path):
    from paytrail.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(GOOD)
    (tmp_path / "in" / "b.txt").write_text(GOOD)
    seen = []
    for _ in range(2):
        q = incremental.audit_stream(incremental.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda rows, n: seen.extend(r.reference for r in rows.collect()))
        q.awaitTermination(120)
    assert seen == ["REF001"]


def test_whole_texts_are_parsed_without_a_shuffle(spark):
    odd = ["{1:F01X}\r\n:20:A \r:70:x\r\n\r\n  y \n-}\nbetween\n:99:no\n{1:F01Y}\n:70:a\n:70:b\n{1:last", "no message", "\n{1:F01Z}\nbefore a tag\n:20:\n-} \n{2:not\n"]
    logs = spark.createDataFrame([(str(i), t) for i, t in enumerate(odd)], "file string, text string")
    pick = lambda logs: sorted((r["file"], r["ordinal"], r["first"], r["ended"], r["raw"], sorted((k, tuple(v)) for k, v in r["fields"].items())) for r in mt103.read_fields(mt103.messages(logs)).collect())
    own = pick(logs)
    assert own == pick(mt103.text_lines(logs)) and [r[:2] for r in own] == [("0", 1), ("0", 2), ("0", 3), ("2", 1)]
    assert own[0][5] == [("20", ("A",)), ("70", ("x", "y"))] and own[1][5] == [("70", ("b",))] and own[3][3:] == (True, "{1:F01Z}\nbefore a tag\n:20:\n-}", [("20", ("",))])
    assert "Exchange" not in mt103.parse_messages(spark.read.text("/dev/null").select(F.lit("f").alias("file"), F.col("value").alias("text")))._jdf.queryExecution().executedPlan().toString()
