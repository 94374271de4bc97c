"""Retries, odd texts, independent versions, and inputs that once were too much."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stackroom.llm import bpe, embedding_dedup, exact_dedup, line_dedup, minhash, packing, pii, sharding, toxicity, url_filter
from stackroom.llm.common import Scratch
from tests.llm.test_near import brute_documents, check_documents

SF = "/root/testdata/sf0.001"


# Exact dedup


def kept(out):
    return {r.doc_id: (r.keep_id, r.kept) for r in out.collect()}


def test_a_batch_that_dies_after_its_append_can_run_again(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, "test_retry", 3)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "a "), (4, "c"), (5, "c "), (6, "d")], "doc_id long, text string")
    exact_dedup.exact_dedup(old, index, "one")
    whole = exact_dedup.DigestIndex.append_new

    def dies(self, rows, batch):
        whole(self, rows, batch)
        raise RuntimeError("lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "append_new", dies)
    with pytest.raises(RuntimeError):
        exact_dedup.exact_dedup(new, index, "two")
    monkeypatch.setattr(exact_dedup.DigestIndex, "append_new", whole)
    want = {3: (1, False), 4: (5, False), 5: (5, True), 6: (6, True)}
    # Dealt otherwise than before, under other settings, and once more.
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        again = exact_dedup.DigestIndex(spark, "test_retry")
        assert again.buckets == 3
        assert kept(exact_dedup.exact_dedup(new.repartition(3), again, "two")) == want
        again.compact()
        assert kept(exact_dedup.exact_dedup(new, exact_dedup.DigestIndex(spark, "test_retry"), "two")) == want
        assert again.read().count() == 4
        assert kept(exact_dedup.exact_dedup(new, again, "three")) == {3: (1, False), 4: (5, False), 5: (5, False), 6: (6, False)}
        spark.sql("ALTER TABLE test_retry RENAME TO test_retry__compacted")  # a compaction that died
        assert exact_dedup.DigestIndex(spark, "test_retry").read().count() == 4
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, "test_retry", 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.sql("DROP TABLE IF EXISTS test_retry")


def test_repeated_rows_keep_one_in_a_retry(spark):
    index = exact_dedup.DigestIndex(spark, "test_repeats", 2)
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    for n in (1, 4):
        out = exact_dedup.exact_dedup(rows.repartition(n), index, "x").collect()
        assert Counter((r.doc_id, r.kept) for r in out) == {(1, True): 1, (1, False): 1, (None, True): 1, (None, False): 1}
    index.drop()


# URL filter, sharding


def test_urls_of_any_bytes_and_rules_in_parts(spark):
    rules = url_filter.parse_rules(["block a.com/", "allow a.com/x/y", "block b.a.com/p", "allow com/", "block a.com/x"])
    urls = ["http://a.com/\0rules//x", "http://a.com/\0path/", "http://a.com/x/y/z", "http://b.a.com/p", "http://b.a.com/q", "http://\0path/", "http://a.com/" + "/" * 5000, "://", "http://c.com/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS verdict", "'z' AS at_host")
    want = ["a.com/", "a.com/", "a.com/x/y", "b.a.com/p", "a.com/", None, "a.com/", None, "com/"]
    for most in (10**6, 12, 1):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules, most=most).collect()}
        assert [got[k][0] for k in range(len(urls))] == want
        assert [got[k][1] for k in (0, 2, 3, 5, 8)] == ["block", "allow", "block", "allow", "allow"]


def test_lookup_table_equals_an_independent_fill():
    for shards, size in ((["a"], 7), (["a", "b", "c"], 101), ([f"s{k}" for k in range(17)], 1009)):
        lists = []
        for s in shards:
            first, step = sharding._seed(s, "offset") % size, sharding._seed(s, "stride") % (size - 1) + 1
            lists.append(iter([(first + k * step) % size for k in range(size)]))
        owner = {}
        for k in itertools.cycle(range(len(shards))):
            if len(owner) == size:
                break
            owner[next(slot for slot in lists[k] if slot not in owner)] = k
        assert sharding.lookup_table(shards, size) == [owner[i] for i in range(size)]


def test_key_columns_of_any_name(spark):
    for name, out in (("slot", "key"), ("shard", "key"), ("_key", "_key")):
        got = sharding.place(spark.range(5).withColumnRenamed("id", name), name, ["a", "b"], 7)
        assert got.columns == [out, "slot", "shard"] and got.count() == 5


# Personal data


def test_candidates_take_linear_time(spark):
    w = pii.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for run in ("a", "1", "1 ", "a.", "a at ", "1.", "(1", "+1"):
        began = time.time()
        for text in (run * (3_000_000 // len(run)), "jo@a.bc " + run * (3_000_000 // len(run)) + "a"):
            base, spans = pii.find(text, w)
            assert set(base) <= set(spans)
        assert time.time() - began < 60, run


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(3)
    s = pii.NONE + 1
    w = pii.Weights(rng.normal(size=(pii.N_FEATURES, s)), rng.normal(size=s), rng.normal(size=(s, s)) / 2, 3.0)
    nodes = [pii.Node(k, k + 1, kind, f"k{k}", [k, 30 + k]) for k, kind in enumerate((None, 2, None, None))]
    assert pii.skip_edges(nodes) == []
    score = np.array([w.bias + w.unary[n.features].sum(0) for n in nodes])
    for i, n in enumerate(nodes):
        if n.kind is None:
            score[i, : pii.NONE] = np.clip(score[i, : pii.NONE], score[i, pii.NONE] - pii.AGAINST, score[i, pii.NONE] - pii.PRIOR)
    want = np.zeros((len(nodes), s))
    for kinds in itertools.product(range(s), repeat=len(nodes)):
        if kinds[1] == 2:
            p = np.exp(sum(score[i, k] for i, k in enumerate(kinds) if i != 1) + sum(w.chain[a, b] for a, b in zip(kinds, kinds[1:])))
            for i, k in enumerate(kinds):
                want[i, k] += p
    want /= want.sum(1, keepdims=True)
    assert np.abs(pii.marginals(nodes, w) - want).max() < 0.01


def test_weights_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, eight = pii.fit(docs.coalesce(1)), pii.fit(docs.repartition(8))
    assert np.allclose(one.unary, eight.unary) and np.allclose(one.chain, eight.chain) and one.skip == eight.skip


def test_recall_of_added_spans(spark):
    w = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    rng, found, planted, false = random.Random(8), 0, 0, 0
    word = lambda: rng.choice(["order", "the", "call", "lake", "and", "for", "ref"])
    for _ in range(300):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        name, host = f"u{rng.randint(1, 999)}", f"mail{rng.randint(1, 99)}"
        facts = f"+1 ({a}) {b}-{c} {word()} {name}@{host}.example.com"
        forms = [f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}{b}{c}", f"{name} at {host} dot example dot com", f"{name} (at) {host} (dot) example (dot) com"]
        other = [f"{rng.randint(10**9, 10**10 - 1)}", f"{rng.randint(100, 999)} {rng.randint(10**6, 10**7 - 1)}", "al at home dot example dot org"]
        text = f"{word()} {facts} {word()}"
        want, clean = set(), set()
        for item, into in sorted([(f, want) for f in rng.sample(forms, 2)] + [(o, clean) for o in rng.sample(other, 2)], key=lambda _: rng.random()):
            text += f" {word()} , {word()} "
            into.add((len(text), len(text) + len(item)))
            text += f"{item} ; {word()}"
        base, spans = pii.find(text, w)
        added = {(lo, hi) for _, lo, hi in set(spans) - set(base)}
        cover = lambda x: any(lo <= x[0] + 1 and hi >= x[1] for lo, hi in added)
        planted, found, false = planted + len(want), found + sum(map(cover, want)), false + sum(map(cover, clean))
    print(found, planted, false)
    assert found >= 0.9 * planted and false <= 0.02 * planted


# Near duplicates, lines


def template_documents(n, share, seed=1):
    rng = random.Random(seed)
    form = [f"t{k}" for k in range(400)]
    size = int(400 * share)
    return [(k, " ".join(form[:size] + [f"x{rng.getrandbits(40)}" for _ in range(400 - size)])) for k in range(n)]


def test_documents_of_one_form_are_no_candidates(spark):
    rows = template_documents(120, 0.88) + [(1000 + k, t) for k, t in template_documents(40, 0.95, 2)]
    check_documents(spark, rows)
    scratch = Scratch(spark)
    entries = [(v, k, 400, 1 + j, 48) for k in range(200) for j, v in enumerate(range(48, 61))]
    lists = spark.createDataFrame([(v, k, n, r + 48, g) for v, k, n, r, g in entries], "v long, id long, n long, rank long, gap long")
    assert minhash.linkable(scratch, lists, 85).count() == 0
    scratch.close()


def test_sizes_that_differ_lose_no_link(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(600)]
    rows = [(k, " ".join(base[: rng.choice([300, 330, 440, 600])] + [f"y{k}_{j}" for j in range(rng.randint(0, 60))])) for k in range(150)]
    sizes = Counter(c for _, c, _ in brute_documents(rows, 85).values())
    assert len(sizes) > 3 and max(sizes.values()) > 10
    check_documents(spark, rows)


def test_very_long_texts(spark):
    words = [f"w{k % 7919}" for k in range(400_000)]
    long_, other = " ".join(words), " ".join(words[:-1000])
    rows = spark.createDataFrame([(1, long_), (2, other), (3, "short text of five words")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    lines = spark.createDataFrame([(1, "\n".join(words)), (2, "\n".join(words[:3000]))], "doc_id long, text string")
    assert {r.doc_id: r.n_deleted > 0 for r in line_dedup.line_dedup(lines, maximal=True).collect()}[2]


def test_ranks_are_places_in_sorted_order(spark):
    rng = random.Random(6)
    keys = [(rng.randint(0, 5), rng.randint(0, 3)) for _ in range(200)] + [(9, 9)]
    scratch = Scratch(spark)
    out = line_dedup.ranked(scratch, spark.createDataFrame(keys, "a long, b long"), "r", "a", "b").collect()
    often = [k for k in keys if keys.count(k) > 1]
    assert Counter((r.a, r.b, r.r) for r in out) == Counter((*k, sum(x < k for x in often)) for k in often)
    scratch.close()


def test_vectors_with_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (5, [2.0, 0.0], 1), (7, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS cell", "3 AS unit", "4 AS uid")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df).collect())
    assert got == {(None, 3, 5, False): 2, (5, 3, 5, True): 2, (7, 0, 7, True): 1}
    rng = np.random.default_rng(1)
    x, p = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    x, p = x / np.linalg.norm(x, axis=1, keepdims=True), p / np.linalg.norm(p, axis=1, keepdims=True)
    whole = embedding_dedup.cells_of(x, p, 0.2)
    embedding_dedup.DISTANCES, most = 400, embedding_dedup.DISTANCES
    parts = embedding_dedup.cells_of(x, p, 0.2)
    embedding_dedup.DISTANCES = most
    assert all((a == b).all() for a, b in zip(whole, parts))


# Tokens


def test_other_vocabularies_and_rows_without_an_id(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    assert [packing.encoder_kind(bpe.public_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")] == [bpe.TreeEncoder, packing.WordEncoder]
    rows = [(1, "Some text, and more."), (None, "x"), (None, None)]
    got = Counter((r.doc_id, r.length) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect())
    assert got == Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    whole = bpe.WholeEncoder(path)
    assert np.frombuffer(whole.encode(["a b"])[0], "<u4").tolist() == plain.encode("a b", add_special_tokens=False).ids


def test_column_generation_ends_near_its_bound(caplog):
    rng = random.Random(5)
    sizes = sorted(rng.sample(range(600, 4000), 60), reverse=True)
    demand = [rng.randint(50, 900) for _ in sizes]
    found = packing.configurations(sizes, demand, 4096)
    assert all(sum(a * s for a, s in zip(p, sizes)) <= 4096 for p, _ in found) and not caplog.records
    packing.configurations(sizes, demand, 4096, max_rounds=2)
    assert "lower bound" in caplog.text


# Toxicity, pipeline


def test_long_texts_are_scored_whole(spark):
    filler = "fine word " * 200_000
    docs = spark.createDataFrame([(i, "bad rotten" if i % 3 == 0 else f"fine w{i % 7}") for i in range(300)] + [(1000, filler + "bad rotten"), (1001, filler)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels, max_labelled=50, max_trained=40).collect()}
    assert got[1000] == 1 and got[1001] == 0


def test_stages_pass_columns_of_any_name(spark):
    rows = [(1, "a b", 7), (2, "ab", 8), (None, "q", 9), (3, "q", 9), (4, None, 1), (5, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs = docs.selectExpr("*", "'s' AS text_sha256", "'i' AS _id", "'h' AS _sha", "'u' AS uid", "'k' AS kept", "'g' AS slot", "'p' AS predicted")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(r.text_sha256, r._id, r._sha, r.uid, r.kept, r.slot, r.predicted) for r in out.collect()} == {("s", "i", "h", "u", "k", "g", "p")}
    once = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "3", "4"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == ["1", "2", "3", "4", "5", "None"]
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_personal_data(spark, docs, SF).collect()}
    assert masked[4] == (None, None) and masked[5] == ("", 0)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() == 6
