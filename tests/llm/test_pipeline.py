import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from tessella.llm import decontam, pieces
from tests.llm.test_near_groups import brute

SF = "/root/testdata/sf0.01"


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        gone = before.keys() - after.keys()
        if name == "language":
            assert all(not any(ch.isalpha() for ch in before[i].text or "") for i in gone if before[i].text is None) and len(gone) < 0.02 * len(before)
        elif name == "near_duplicates":
            kept = brute([(i, r.text) for i, r in before.items()])
            assert kept <= after.keys() and len(after.keys() - kept) <= 0.002 * len(kept)
        elif name == "decontamination":
            m = decontam.Matcher(items, 0.8)
            assert gone == {i for i, r in before.items() if m.matches(decontam.words(r.text.encode()))}
        elif name == "personal_data":
            assert not gone and any("[EMAIL]" in r.text for r in after.values())
            assert all(r.text == before[i].text for i, r in after.items() if "[" not in r.text)
        else:
            own = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
            assert all(after[i].n_tokens == len(own.encode(before[i].text)) for i in list(after)[:40])
            break
        assert out.columns == cols
        docs = out


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, None, "en", "s", None), (10**6 + 1, "", None, None, 0)], docs.schema))
    for table in (odd, docs.where("false")):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF).checkpoint()
        assert now.count() <= table.count()


def test_texts_go_to_python_in_small_batches(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('a b', id), 1000) AS text", "'en' AS lang", "'s' AS source", "5000L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    corpus_pipeline.encoding(spark, docs, SF)
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) < 5 << 20
