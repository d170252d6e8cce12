from pyspark.sql import functions as F

import corpus_pipeline as cp
from coppice.llm import packing, secrets, simhash, suffix_dedup, toxicity
from coppice.plans.lineage import cut
from tests.llm.fixtures import SF, frame, prose
from tests.llm.test_secrets import plain
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens import verify


def test_each_stage_on_what_the_last_one_kept(spark):
    assert [k for k, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}

    out = cut(cp.drop_toxic(spark, docs, SF))
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.score >= toxicity.THRESHOLD}
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(got) == set(seen) - rejected and all(got[i] == seen[i] for i in got)

    ids = sorted(got)
    component = plain_components(ids, [plain_fingerprint(got[i].text) for i in ids])
    last, out = got, cut(cp.drop_near_copies(spark, out, SF))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(got) == set(component) and all(got[i] == last[i] for i in got)

    last, out = got, cut(cp.drop_repeats(spark, out, SF))
    got = {r.doc_id: r for r in out.collect()}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(last.values()), docs.schema)).collect()}
    assert out.columns == columns and set(got) == set(last) and all(got[i].text == kept[i].decode(errors="ignore") and got[i].n_chars == len(got[i].text) for i in got)

    last, out = got, cut(cp.redact_secrets(spark, out, SF))
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(last) and out.columns == columns
    scanner = secrets.Scanner()
    for i, r in got.items():
        assert r.text == secrets.redact(last[i].text, scanner.scan([last[i].text])[0]) and plain(r.text)[0][:3] == [0, 0, 0]

    verify([(i, r.text) for i, r in got.items()], cp.pack(spark, out, SF).collect())


def test_whole_run_and_awkward_rows(spark, tmp_path):
    texts = [None, "", "one", prose(1, 90), prose(1, 90), "password=abcdefgh12 " + prose(2, 80)]
    docs = frame(spark, texts)
    docs.unionByName(docs.limit(3)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {0, 2, 3, 5} and len(rows) == 4
    assert packing.LENGTH == 2048 and simhash.RADIUS == 3


def test_edges_of_cuts_leave_whole_characters(spark):
    raw = [b"a\xe2\x82b", "\ufffd kept \x01\x02\x01\x03".encode() + b"\xc3", "\x01\ufffd".encode() * 3, b"\x82\xac", b"", "é…".encode()]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, raw))), "i int, b binary").select("i", cp._whole_characters(F.col("b").cast("string")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [b.decode(errors="ignore") for b in raw]
    passage = prose(5, 60) + " \ufffd "
    texts = [prose(1, 20) + " \ufffd é" + passage + "end", "\ufffd " + prose(2, 20) + passage, "\ufffd alone"]
    kept = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    got = {r.doc_id: r.text for r in cp.drop_repeats(spark, frame(spark, texts), SF).collect()}
    assert got == kept and all("\ufffd" in t for t in got.values()) and len(got[0]) < len(texts[0])


def test_repeated_ids_leave_one_row_of_each_group(spark):
    words = prose(1, 600).split()
    texts = [" ".join(words), *(" ".join([*words[:k], "zzz", *words[k + 1 :]]) for k in range(600))]
    base = plain_fingerprint(texts[0])
    near = [t for t in texts if 1 <= (plain_fingerprint(t) ^ base).bit_count() <= simhash.RADIUS][:3]
    assert len({plain_fingerprint(t) for t in near} | {base}) > 1
    other = prose(9, 80)  # another group, with the same smallest id
    rows = [(1, texts[0]), *((1, t) for t in near), (1, other), (1, other), (2, other), (3, near[0])]
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {1} and sum(r.text == other for r in got) == 1
