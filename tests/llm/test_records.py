"""URL filter, sharding, exact dedup, packing and byte-pair encoding."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from stackroom.llm import bpe, exact_dedup, packing, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"
BYTES, WORDS = bpe.public_path("byte_bpe_50k.json"), bpe.public_path("word_bpe_49k.json")
ALPHABETS = ["ab", "abcde ", "aé漢字ß", "0123456789", "thein gs", "́a b\n\t ", " \n  x", "!?.,-", "it's DON'T …", "İIſŉé½²³ªº×÷µ", "Σσς K"]


def odd_text(rng, most=300):
    alphabet = rng.choice(ALPHABETS)
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) + rng.choice(["", "", "<|endoftext|>x", "  ", "<|startoftext|>"])


# URL filter


def brute_rule(rules, url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(2)
    hosts, parts = ["com", "example.com", "www.example.com", "a.b.example.com", "xexample.com", "net", "co.uk", "EXAMPLE.COM", ""], ["", "/", "/en", "/en/", "/en/a", "/enx", "/es/", "//", "/en//a"]
    rules = list({(h, p): url_filter.Rule(rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(hosts[:7]), rng.choice(parts)) for _ in range(30))}.values())
    urls = [(i, rng.choice(["http://", "https://", "://", "x", "a://b://"]) + rng.choice(hosts) + rng.choice(parts) + rng.choice(["", "?q=/en/", "#x", "/z"])) for i in range(600)] + [(600, None), (601, "")]
    for rs in (rules, url_filter.parse_rules(queries.URL_RULES), []):
        df = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rs).collect()}
        assert got == {i: brute_rule(rs, u) for i, u in urls}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.parse_rules(["deny x/"])


# Sharding


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(10)]
    table = sharding.lookup_table(names, 5003)
    load = Counter(table)
    assert max(load.values()) - min(load.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 5003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9) / 5003
    assert moved < 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 5004)


def test_places_equal_brute_force(spark):
    keys = [(k,) for k in (*range(500), 7, 7, -1)] + [(None,)]
    df = spark.createDataFrame(keys, "doc_id long").selectExpr("*", "'x' AS shard", "1 AS slot")
    table = sharding.lookup_table(queries.SHARDS)
    slot = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    got = Counter((r.doc_id, r.slot, r.shard) for r in sharding.place(df, "doc_id", queries.SHARDS).collect())
    assert got == Counter((k, slot(k), queries.SHARDS[table[slot(k)]]) for (k,) in keys)
    assert sharding.place(df.limit(0), "doc_id", queries.SHARDS).count() == 0


def test_write_sharded(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, f"t{i}") for i in range(200)] + [(None, "n")], "doc_id long, text string")
    sharding.write_sharded(df, "doc_id", ["a", "b", "c"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 201
    assert back.select("doc_id", "_shard").distinct().groupBy("doc_id").count().where("count > 1").isEmpty()


# Exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    best = {bare: min(g)[3] for bare, g in groups.items()}
    return Counter((i, best[bare], len(g), hashlib.sha256(bare.encode()).hexdigest()) for bare, g in groups.items() for _, _, _, i in g)


def test_exact_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([i, i, None]), rng.choice([None, "", "a", " a", "a ", "b\tb", "bb", "é\u00a0", "é", "\x1c", f"u{i}"])) for i in range(300)] + [(5, "a  "), (5, "a  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS uid", "3 AS keep_id")
    out = exact_dedup.exact_dedup(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute_exact(rows)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in out}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_index_persists_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, "test_digest_index", 4)
    first = spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  "), (5, "c"), (6, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(first, index).where("kept").collect()) == [2, 3]
    again = exact_dedup.DigestIndex(spark, "test_digest_index", 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(second, again).collect()}
    assert got == {4: (2, False), 5: (5, True), 6: (5, False)}
    assert again.read().count() == 3
    index.drop()


# Byte-pair encoding


def test_tree_concatenation_equals_the_library():
    rng = random.Random(3)
    encoder, plain = bpe.TreeEncoder(BYTES), Tokenizer.from_file(BYTES)
    for _ in range(400):
        encoder.leaf, encoder.known = rng.choice([4, 8, 16, 64]), {}
        text = odd_text(rng)
        ids = plain.encode(text, add_special_tokens=False).ids
        got = encoder.encode([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert encoder.decode(got) == plain.decode(ids, skip_special_tokens=False)
    for letters in ("thequickbrownfox", "a", "漢字", "01"):
        text = "".join(rng.choice(letters) for _ in range(40_000))
        encoder.leaf = 2048
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_round_trip_query(spark):
    plain = Tokenizer.from_file(BYTES)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(10**9, None), (None, ""), (10**9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")

    def expect(i, t):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(tuple(r) for r in bpe.encode_round_trip(df, BYTES).collect()) == Counter(expect(*r) for r in rows)
    ids = bpe.encode_column(df, BYTES)
    back = Counter((r.doc_id, r.text) for r in bpe.decode_column(ids, BYTES).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    assert bpe.encode_round_trip(df.limit(0), BYTES).count() == 0


# Packing


def test_words_equal_the_library():
    rng = random.Random(4)
    encoder, plain = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [odd_text(rng) for _ in range(500)]
    for k in range(0, 500, 50):
        got = encoder.encode(texts[k : k + 50])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts[k : k + 50]]


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(*rng.choice([(1, 4096), (1, 60), (1300, 2100)])): rng.randint(1, 400) for _ in range(rng.randint(1, 120))}
    runs, bins = packing.plan(dict(counts))
    got, held = Counter(), {}
    for length, lo, hi, first, per, at in runs:
        got[length] += hi - lo
        for k in range(hi - lo):
            held.setdefault(first + k // per, []).append((at + k % per * length, length))
    assert got == Counter(counts) and len(held) == bins
    for places in held.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 4096
    volume = -(-sum(k * n for k, n in counts.items()) // 4096)
    assert volume <= bins <= best_fit(counts)


def best_fit(counts):
    """Sequences that plain best-fit decreasing takes, and a hundredth more."""
    free, bins = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r in free if r >= length and free[r]), default=None)
            if room is None:
                bins, room = bins + 1, 4096
            else:
                free[room] -= 1
                if not free[room]:
                    del free[room]
            if room > length:
                free[room - length] += 1
    return bins * 1.01 + 3


def test_packing_query(spark):
    plain = Tokenizer.from_file(WORDS)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(10**9, None), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "word, " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS part").repartition(5)
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    out = packing.pack(df, WORDS).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    end = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end[r.sequence_id]
        end[r.sequence_id] += r.length
    assert max(end.values()) <= 4096
    assert packing.pack(df.limit(0), WORDS).count() == 0
