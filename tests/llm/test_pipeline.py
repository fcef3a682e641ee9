import random
import re

import corpus_pipeline
import xxhash
from gridweft.llm import simhash, similar
from pyspark.sql import functions as F


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def make(rng, n=150):
    vocabulary = ["".join(rng.choices("aeioustnrl", k=rng.randint(2, 8))) for _ in range(2000)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 400)) for _ in range(n)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(max(1, len(copy) // 100)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_one_document_of_each_near_group_stays(spark):
    rng = random.Random(4)
    texts = make(rng) + [None, "", " ", "two words", "two words", "long " * 40_000]
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, fp string")
    out = simhash.similar_groups(df)
    assert out.columns == ["row", "kept"] and out.select("row.*").columns == df.columns
    got = {r.row.doc_id for r in out.collect() if r.kept}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i], texts[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = set(root)
    assert got == want
    assert simhash.similar_groups(df.where("false")).count() == 0


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "123 456", "en", "src1", 7), (None, "und so weiter in der", None, "src1", 5), (-3, "", "en", None, 0)], src.schema)
    src.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == src.columns
            assert docs.drop("lang").exceptAll(before.drop("lang")).count() == 0
        if name == "language_id":
            assert before.count() - counts[-1] >= 3 and counts[-1] >= 1000
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()]
            assert len(set(texts)) == len(texts)
            assert set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in before.collect()}
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, final.select("doc_id", "ids_sha256").collect())) == sorted(map(str, docs.select("doc_id", "ids_sha256").collect()))
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())


EXTRA = ["lang_pred", "score", "phrase_chars", "kept", "sampled", "row", "fp", "size", "token", "gw_u", "weight", "id", "a.b"]


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)]).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == want
        assert now.select(*[f"`{c}`" for c in EXTRA]).distinct().collect() == [tuple(range(len(EXTRA)))]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() > 0


def test_an_empty_table_runs_through(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_language_stage_rejects_unknown_scripts_and_names_unlabelled_texts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = docs.where("lang = 'fr'").limit(3).withColumns({"lang": F.lit(None).cast("string"), "doc_id": -F.col("doc_id") - 10})
    odd = spark.createDataFrame([(-1, "日本語の文章です " * 40, "en", "s", 9), (-2, "λόγος " * 50, None, "s", 9)], docs.schema)
    out = corpus_pipeline.language_id(spark, docs.unionByName(some).unionByName(odd), "")
    assert out.count() == docs.count() + 3 and out.where("doc_id in (-1, -2)").count() == 0
    assert {r.lang for r in out.where("doc_id < 0").collect()} == {"fr"}


def plain_fingerprint(text):
    """SimHash of the distinct five-word shingles, bit by bit."""
    hashes = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in shingles(text)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def bits_apart(a, b):
    return (a ^ b).bit_count()


def test_near_stage_links_by_simhash_and_by_similarity(spark):
    """Texts under the similarity that SimHash has within 4 bits are linked, as are those that only the similarity links."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("aeioustnrl", k=rng.randint(3, 8))) for _ in range(3000)]
    junk = " ".join(rng.choices(vocabulary, k=10)) + " "
    texts, only_simhash = [None, "", "six words are two shingles here", *[junk * 50 + " ".join(rng.choices(vocabulary, k=80)) for _ in range(4)]], 0
    for _ in range(40):
        base = rng.choices(vocabulary, k=150)
        first = plain_fingerprint(" ".join(base))
        texts.append(" ".join(base))
        for _ in range(30):
            copy = list(base)
            for k in rng.sample(range(150), rng.choice([2, 4, 4])):
                copy[k] = rng.choice(vocabulary)
            text = " ".join(copy)
            near = bits_apart(plain_fingerprint(text), first) <= 4
            if near and not alike(text, texts[-1]):
                only_simhash += 1
                texts.append(text)
                break
        else:
            texts.append(text)
    prints = [plain_fingerprint(t) if shingles(t) else None for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            close = None not in (prints[i], prints[j]) and bits_apart(prints[i], prints[j]) <= 4
            if root[i] != root[j] and (close or alike(texts[i], texts[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert only_simhash >= 3 and len(set(root)) < len(texts) - only_simhash
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(root)
    assert {r.row.doc_id for r in simhash.similar_groups(df, link=4, bucket=2).collect() if r.kept} == set(root)


def test_sets_of_one_fingerprint_are_one_group(spark):
    """Rows of a fingerprint hang on its first row, which stands for it; rows without a fingerprint hang on none."""
    table = spark.createDataFrame([(0, 5), (1, 5), (2, 5 ^ 15), (3, -1), (4, None), (5, None), (6, 5 ^ 31)], "row long, fp long")
    got = {tuple(sorted(e)) for e in similar.fingerprint_links(table, 4, 64).collect()}
    assert got == {(0, 1), (0, 2), (2, 6)}
