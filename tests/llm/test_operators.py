"""The training-data operators on odd inputs, and against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rivulet.llm import chat, embedding_dedup, ngram_join, packing, pairs, quality, secret_scan, sharding, tokens, toxicity, urls

JSON_FILE, RANK_FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = "lorem ipsum dolor " * 9_000
ODD = [None, "", " \n\t ", "word", "two words", "Ünïcode ßtraße 日本語 🙂", LONG, "x" * 40_000, "a\x00b", "a \u2003\u3000 b\x1c c\x85d", "it's they'll 'tis", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts; ids with a null and a repeat; columns whose names clash with results."""
    rows = [(None if i == 3 else i, t, "en", i % 2, float(i), "old") for i, t in enumerate(ODD)] + [(12, "same text", "en", 1, 1.0, "old")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, score double, kept string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---------------------------------------------------------------- tokens and packing
def reference_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, n):
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'", "'ll", "'s", "9", "123", "é", "ß", "日", "🙂", "!", "...", "\u2003", "\x85", "\x1c", "q" * 30, "<|endoftext|>"]
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_tree_encoding_equals_the_library_for_every_leaf_size():
    rng, plain = random.Random(3), reference_encoder()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANK_FILE, "rb"))}
    texts = [random_text(rng, rng.randrange(1, 400)) for _ in range(150)] + [t or "" for t in ODD]
    for leaf in (1, 2, 7, 64):
        codec = tokens.Codec(ranks, PATTERN, leaf=leaf)
        for t in texts if leaf > 2 else [x for x in texts if len(x) < 3_000]:
            ids = codec.encode(t)
            assert ids.tolist() == plain.encode_ordinary(t)
            assert codec.decode(ids) == t.encode()


def test_json_codec_equals_the_tokenizers_library():
    rng, plain = random.Random(4), Tokenizer.from_file(JSON_FILE)
    codec = tokens.json_codec(JSON_FILE, PATTERN)
    for t in [random_text(rng, 60) for _ in range(200)] + [t or "" for t in ODD]:
        assert codec.encode_with_special(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_digests_and_arrays(odd, nothing):
    plain = reference_encoder()
    got = sorted(tuple(r)[1:] for r in tokens.token_digests(odd, RANK_FILE, PATTERN).collect())
    want = []
    for t in [*ODD, "same text"]:
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        want.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = tokens.encode_documents(odd, RANK_FILE, PATTERN)
    assert full.columns == [*odd.columns, "ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in full.collect())
    assert tokens.token_digests(nothing, RANK_FILE, PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_piece_lengths_are_powers_of_two(n):
    sizes = packing.piece_lengths(n, 2048)
    assert sum(sizes) == n and all(s & (s - 1) == 0 and s <= 2048 for s in sizes) and sizes == sorted(sizes, reverse=True)
    assert len({s for s in sizes if s < 2048}) == len([s for s in sizes if s < 2048])


def test_pack_holds_each_token_once_without_padding(odd, nothing):
    plain = Tokenizer.from_file(JSON_FILE)
    rows = packing.pack(odd.withColumnRenamed("n_words", "length"), JSON_FILE, PATTERN, longest=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    for i, t in enumerate(ODD[:3]):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == [*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
    assert packing.piece_table(nothing, JSON_FILE, PATTERN).count() == 0
    assert all(r["ids"] is None for r in packing.pack(odd, JSON_FILE, PATTERN, with_ids=False).collect())


def test_buckets_are_written_by_length(odd, spark, tmp_path):
    packing.write_buckets(packing.pack(odd.select("doc_id", "text"), JSON_FILE, PATTERN, longest=16), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("bucket <> length").count() == 0 and back.count() > 0


# ---------------------------------------------------------------- sharding
def test_shards_follow_the_key_alone(odd, nothing, spark):
    rows = sharding.shard_table(odd, 4).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 4) and r["size"] >= 8
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] == 12}) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 0} == {(8, 0)}
    assert sharding.shard_table(nothing, 4).count() == 0


def test_weights_set_the_shares_and_few_rows_move(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(keys, {0: 1.0, 1: 3.0}).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(keys, {0: 1.0, 1: 3.0, 2: 1.0}).collect()}
    assert abs(sum(a.values()) / len(a) - 0.75) < 0.02
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 2 for k in moved) and abs(len(moved) / len(a) - 0.2) < 0.02


def test_one_hot_key_still_gets_gapless_slots(spark):
    rows = spark.range(3_000).selectExpr("if(id < 1000, 7L, id) as doc_id", "'t' as text")
    got = sharding.shard_table(rows, 3).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in got)


# ---------------------------------------------------------------- embeddings
def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 24))
    rows = []
    for i, b in enumerate(base):
        for _ in range(1 + i % 4):
            rows.append((b + rng.standard_normal(24) * 0.03, i % 3))
    rows += [(base[0] + rng.standard_normal(24) * 0.02, 0) for _ in range(150)]  # a crowd
    rows += [(base[1].copy(), 1) for _ in range(90)]  # equal vectors
    data = [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(rows)]
    n = len(data)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] * 24, [inf] * 24, [None] * 24, [1.0, 2.0]]
    data += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 10, data[0][1], None), (n + 11, [2 * x for x in data[0][1]], 0), (n + 12, [1e300 * x for x in data[0][1]], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("component_id", __import__("pyspark").sql.functions.lit("old"))
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df).collect()}
    good = [(i, np.array(v) / np.abs(v).max(), l) for i, v, l in data if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: (v / np.linalg.norm(v), l) for i, v, l in good}
    ids = sorted(unit)
    links = {i: {j for j in ids if j != i and unit[i][1] == unit[j][1] and len(unit[i][0]) == len(unit[j][0]) and unit[i][0] @ unit[j][0] >= 0.93} for i in ids}
    comp = {i: i for i in got}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([comp[i], *[comp[j] for j in links[i]]])
            changed, comp[i] = changed or low < comp[i], low
    assert len(got) == len(data)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links.get(i, ())), comp[i], comp[i] == i)
    assert embedding_dedup.link_vectors(df.where("false")).count() == 0


def test_expected_recall_rises_with_the_cosine_and_holds_at_every_size():
    for rows in (10, 8_192, 10**5, 10**8):
        k, tables = embedding_dedup.hash_sizes(rows, 0.93)
        values = [embedding_dedup.expected_recall(c, k, tables) for c in (0.5, 0.8, 0.93, 0.95, 1.0)]
        assert values == sorted(values) and values[2] > 0.989 and values[-1] == 1.0
        assert rows * embedding_dedup.together(0.0) ** k < 0.1 or rows <= 8_192  # unrelated vectors per vector and table


def test_labels_and_vectors_with_commas_stay_apart(spark):
    rows = [(1, [2.0], "a,1.0"), (2, [1.0, 2.0], "a"), (3, [2.0], "a,1.0"), (4, [4.0], "a,1.0"), (5, [2.0], "1,a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (0, 2), 3: (2, 1), 4: (2, 1), 5: (0, 5)}


def test_large_buckets_lose_and_repeat_no_pair(spark):
    rng = random.Random(2)
    groups = [rng.sample(range(400), k) for k in (2, 3, 60, 120, 60, 5)]
    members = spark.createDataFrame([(k, i) for k, g in enumerate(groups) for i in g], "key long, id long")
    found, crowds = pairs.candidates(members)
    small = [(r["i"], r["j"]) for r in found.collect()]
    crowd = {r["id"]: (r["crowd"], r["size"]) for r in crowds.collect()}
    assert len(small) == len(set(small))
    for g in groups:
        for a in g:
            for b in g:
                if a < b:
                    together = a in crowd and b in crowd and crowd[a][0] == crowd[b][0]
                    assert together != ((a, b) in set(small))
    met = pairs.units(crowds, block=16).groupBy("crowd", "lo", "hi").count().collect()
    assert max(r["count"] for r in met) <= 64 and met


# ---------------------------------------------------------------- quality
def plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, x in enumerate(triples) if triples.count(x) > 1 for k in range(3)}
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_equal_a_plain_version():
    rng = random.Random(5)
    pieces = ["a", "b", "c", " ", " ", "\n", "\t", "\x0b", "#", "é", "\x1c", "<|", "line one\n"]
    for t in [t or "" for t in ODD if t is None or len(t) < 1_000] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(200))) for _ in range(300)]:
        assert quality.count_text(t)[:5] == plain_counts(t)


def test_repeats_with_very_many_kinds():
    ids = np.array([5, 6, 7, 1, 5, 6, 7, 8])
    assert quality.covered_by_repeats(ids, 1 << 40) == quality.covered_by_repeats(ids, 9) == 6


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (1_000, 3)), [[9, 9, 9]]])
    score = quality.grow(x).score(x)
    assert score.argmax() == 1_000 and score.max() > 0.7 and np.median(score) < 0.55


def test_path_lengths_equal_a_plain_forest():
    """Every row's way through every tree, step by step; at a leaf the depth and the expected rest of the path for the rows that fell there."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (300, 4)), rng.normal(5, 3, (6, 4)), np.zeros((3, 4))])
    forest = quality.grow(x, trees=25)
    first = x[np.random.default_rng(quality.SEED).choice(len(x), min(quality.PER_TREE, len(x)), replace=False)]  # what the first tree was grown on

    def walk(row, node):
        way = [node]
        while forest.feature[node] >= 0:
            node = int(forest.left[node]) + int(row[forest.feature[node]] > forest.split[node])
            way.append(node)
        return way

    fell = Counter(walk(row, int(forest.roots[0]))[-1] for row in first)
    for row in first:
        way = walk(row, int(forest.roots[0]))
        assert forest.path[way[-1]] == pytest.approx(len(way) - 1 + float(quality.expected_path(fell[way[-1]])))
    total = np.array([sum(forest.path[walk(row, int(root))[-1]] for root in forest.roots) for row in x])
    assert np.allclose(forest.score(x), 2.0 ** (-total / 25 / forest.norm))
    assert quality.expected_path(256) == pytest.approx(2 * sum(1 / i for i in range(1, 256)) - 2 * 255 / 256, rel=0.01)


def test_one_and_two_passes_give_the_same_verdicts(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("***" if i % 10 == 0 else "") for _ in range(80)) for i in range(200)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    one = {r["doc_id"]: r["kept"] for r in quality.quality_table(docs_of(spark, texts), labels).collect()}
    assert one == {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(spark, texts), labels).collect()}


def test_quality_judges_odd_rows_and_catches_junk(spark, odd, nothing):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() + ("***" if i % 10 == 0 else "") for _ in range(80)) for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 400, 2)] + [(None, None, None), (1_000, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_table(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 10 > 0) for r in rows)
    out = quality.judge(odd, labels)
    assert out.count() == len(ODD) + 1 and out.where("kept").count() <= 3 and "lang" in out.columns
    assert quality.judge(nothing, labels).count() == 0
    assert quality.quality_table(docs, labels.where("false")).where("kept").count() == 400


# ---------------------------------------------------------------- urls
def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_scores(forms):
    """Witten-Bell models by dictionaries."""
    def model(side):
        seen = [{} for _ in range(4)]
        for f, n in forms.items():
            if zlib.crc32(f.encode()) % 5 and n[side]:
                p = "^^^" + f
                for i in range(len(f)):
                    for k in range(4):
                        ctx = p[i + 3 - k : i + 3]
                        seen[k].setdefault(ctx, {}).setdefault(p[i + 3], 0)
                        seen[k][ctx][p[i + 3]] += n[side]

        def prob(p, i):
            value = 1 / 32
            for k in range(4):
                own = seen[k].get(p[i + 3 - k : i + 3])
                if own:
                    total, kinds = sum(own.values()), len(own)
                    value = (own.get(p[i + 3], 0) + kinds * value) / (total + kinds)
            return value

        return prob

    a, r = model(0), model(1)
    return {f: float(np.mean([np.log(a("^^^" + f, i)) - np.log(r("^^^" + f, i)) for i in range(len(f))])) if f else 0.0 for f in forms}


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q", "http://example.org/en/12", "http://example.org/en/2#a://b", "http://x.com/de/1", "http://x.com/fr", "http://x.com/fr/", "ftp://com/de/", "http://xcom/de/", "http://org", "http://org/", "a://b://c/d", "http://É.org/ü", "http://x.net/" + "long/" * 4_000, "http://x.net/1\n2"]


def test_urls_equal_a_plain_version(spark):
    rng = random.Random(7)
    many = [f"https://{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['alpha', 'beta', 'gamma'])}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'fr', 'en', 'es'])}/{rng.choice(['news', 'shop', 'wiki'])}{rng.randrange(40)}" for _ in range(400)]
    data = list(enumerate([*URLS, *many]))
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in data], "page_id long, url string, host string, gram int")
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    form = lambda u: re.sub(r"[^a-z0.\-/]", "~", re.sub("[0-9]+", "0", (u or "").lower()))
    rule_of, forms = {}, {}
    for i, u in data:
        host, path = plain_host_path(u)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule_of[i] = max(fits)[1:] if fits else (None, None)
        n = forms.setdefault(form(u), [0, 0])
        if rule_of[i][1]:
            n[rule_of[i][1] == "block"] += 1
    scores = plain_scores(forms)
    held = sorted({round(np.floor(scores[f] / 0.01)) for f in forms if zlib.crc32(f.encode()) % 5 == 0})
    right = {}
    for b in held:
        side = [[n[k] * (np.floor(scores[f] / 0.01) < b) for f, n in forms.items() if zlib.crc32(f.encode()) % 5 == 0] for k in (0, 1)]
        total = [sum(n[k] for f, n in forms.items() if zlib.crc32(f.encode()) % 5 == 0) for k in (0, 1)]
        right[b] = (total[0] - sum(side[0])) / total[0] + sum(side[1]) / total[1]
    limit = max(held, key=lambda b: (round(right[b], 12), -abs(b))) * 0.01
    for i, u in data:
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (*plain_host_path(u), rule_of[i][0])
        assert r["url_score"] == pytest.approx(scores[form(u)], abs=1e-9)
        if rule_of[i][1] or abs(scores[form(u)] - limit) > 1e-9:
            assert r["verdict"] == (rule_of[i][1] or ("allow" if scores[form(u)] >= limit else "block"))
    assert len(got) == len(data)


def test_urls_without_rows_or_examples(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty).count() == 0
    rows = urls.judge_urls(spark.createDataFrame([(1, "http://x.net/a"), (1, "http://x.net/a")], "page_id long, url string")).collect()
    assert [r["verdict"] for r in rows] == ["allow", "allow"]


def test_urls_take_clashing_columns(spark):
    rows = [(1, "http://x.org/a", "old", "old", 5, 6.0), (2, "http://x.net/b", None, "old", 5, 6.0)]
    out = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, by_model__ string, Verdict string, form__ int, URL_Score double"))
    assert sorted(c.lower() for c in out.columns) == sorted(["page_id", "url", "by_model__", "form__", "host", "path", "rule", "verdict", "url_score"])
    assert {r["page_id"]: (r["by_model__"], r["form__"], r["rule"]) for r in out.collect()} == {1: ("old", 5, "org/"), 2: (None, 5, None)}
    with pytest.raises(ValueError, match="name of a result"):
        urls.judge_urls(spark.createDataFrame([("a",)], "path string"), url="path")


# ---------------------------------------------------------------- secrets
def test_base_secrets_equal_a_plain_version():
    rng = random.Random(8)
    parts = ["token", "TOKEN", "api_key", "apikey", "secret", "passwd", ":", "=", " ", '"', "'", "abc", "12345678", "deadbeef" * 4, "AKIA", "ABCDEFGH1234", "é", "ſecret", "\n"]
    for _ in range(2_000):
        t = "".join(rng.choice(parts) for _ in range(12))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [s for s in secret_scan.find_spans(t) if s[0] != "entropy"] == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_entropy_windows_equal_a_plain_version():
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("abcd0123XYZ"[: rng.randrange(2, 12)]) for _ in range(rng.randrange(1, 70)))
        least, hit = rng.uniform(1.5, 3.4), set()
        for i in range(len(t) - 19):
            w = t[i : i + 20]
            if -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w)) >= least - 1e-9:
                hit |= set(range(i, i + 20))
        assert {x for a, b in secret_scan.high_entropy(t, least) for x in range(a, b)} == hit


@pytest.mark.parametrize("text,found", [
    ("key wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY here", True),
    ("sk-9aF3kLq8ZxT2vB7nM4cR1wY6", True),
    ("andanedingtheronatiouserstwhingtionble", False),
    ("123e4567-e89b-12d3-a456-426614174000", False),
    ("2024-01-01/2024-02-01/2024-03-01", False),
    ("http://www.example.com/some/long/path-with-words/page12", False),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", False),
])
def test_allow_list(text, found):
    assert any(s[0] == "entropy" for s in secret_scan.find_spans(text)) == found


@pytest.mark.parametrize("glue", ["session_id=", "sess_", "key-", "id/", "sig=", "build_", "a+"])
def test_glued_tokens_are_held_to_the_limit_of_their_own_class(glue):
    rng = random.Random(10)
    for chars, n in (("0123456789abcdef", 24), ("0123456789abcdef", 31), ("0123456789ABCDEF", 20), ("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 26), ("abcdefghijklmnopqrstuvwxyz0123456789", 25)):
        for _ in range(100):
            token = "".join(rng.choice(chars) for _ in range(n))
            cover = lambda t: {x for _, a, b in secret_scan.find_spans(t) for x in range(a, b)}
            alone, glued = cover(token), cover(glue + token + "_x")
            assert {x + len(glue) for x in alone} <= glued


@pytest.mark.parametrize("text", ["session_id=andanedingtheronatiouserstwhingtionble", "R2_internationalizationservices_Q4z", "id=12345678901234567890123", "X1y2_aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "Ab1Cd2" + "=" * 30])
def test_glued_words_and_numbers_stay(text):
    assert secret_scan.find_spans(text) == []


@pytest.mark.parametrize(("chars", "n", "share"), [("abcdefghijklmnopqrstuvwxyz", 24, 0.9), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 24, 0.9), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 0.95), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 40, 0.98)])
def test_random_tokens_are_found_whole(chars, n, share):
    rng = random.Random(21)
    whole = part = 0
    for _ in range(1_000):
        token = "".join(rng.choice(chars) for _ in range(n))
        covered = sum(b - a for _, a, b in secret_scan.find_spans(f"a {token} b"))
        whole, part = whole + (covered == n), part + (0 < covered < n)
    assert whole >= share * 1_000 and part <= 10


@pytest.mark.parametrize("word", ["Donaudampfschifffahrtsgesellschaft", "internationalization", "anticonstitutionnellement", "electroencefalografista", "ARBEITERUNFALLVERSICHERUNG", "someVeryLongMethodNameInCode"])
def test_long_words_are_no_secrets(word):
    assert secret_scan.find_spans(f"the {word} here") == []


def test_scan_keeps_rows_and_redacts(odd, nothing, spark):
    out = secret_scan.scan(odd)
    assert out.count() == len(ODD) + 1 and out.where("secret_spans <> ''").count() == 0
    row = secret_scan.scan(docs_of(spark, ['say token = "0123456789abcdef0123456789abcdef01" now'])).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"], row["redacted"]) == (1, 0, 1, 'say [SECRET]" now')
    assert secret_scan.scan_table(nothing).count() == 0


# ---------------------------------------------------------------- toxicity
def test_kernel_folds_into_weights_and_tolerates_gaps():
    rng = random.Random(10)
    good = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 10))) for _ in range(600)]
    machine = toxicity.train(["scoundrel", "blockhead", "numbskull"] * 3, good, landmarks=64)
    score = dict(zip(["scoundrel", "sco_undrel", "scundrel", "bl0ckhead", "tolerant"], machine.margins([p for w in ("scoundrel", "sco_undrel", "scundrel", "bl0ckhead", "tolerant") for p in toxicity.pieces(w)])))
    assert score["tolerant"] < 0 < min(v for k, v in score.items() if k != "tolerant")
    marks = ["alpha", "betas"]
    plain = lambda x, y: sum(u * v for f, u in feats(x).items() for g, v in feats(y).items() if f == g)

    def feats(w):
        c, out = [int(v) for v in toxicity.encode([w])[0] if v], {}
        for a, b, weight in toxicity._SKIPS:
            for i in range(len(c) - a - b):
                key = (c[i], c[i + a], c[i + a + b])
                out[key] = out.get(key, 0) + weight
        return out

    norm = lambda w: toxicity._NORMS[len(w) + 2]
    for x in ("alphabet", "beta", ""):
        assert np.allclose(toxicity.kernel([x], marks)[0], [plain(x, m) / norm(x) / norm(m) for m in marks], atol=1e-5)


def test_pieces_cover_long_words():
    word = "abcdefghij" * 10
    got = toxicity.pieces(word)
    assert all(len(p) <= toxicity.WIDTH for p in got) and set("".join(got)) == set(word) and got[-1].endswith(word[-3:])
    assert "idiot" in toxicity.instances("you i d i o t there")


def test_toxicity_learns_held_out_documents(spark, odd, nothing):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ta", "lo", "ri", "me", "nu"]) for _ in range(rng.randrange(1, 5)))
    texts = [" ".join([word() for _ in range(30)] + ([rng.choice(["blockhead", "scoundrel", "numbskull"])] if i % 3 == 0 else [])) for i in range(600)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_table(docs, labels).collect()
    assert {r["held_out"] for r in rows} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in rows if r["held_out"]) >= 0.97 * sum(r["held_out"] for r in rows)
    machine = toxicity.fit(docs, labels)
    out = toxicity.score(odd, machine).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(nothing, machine).count() == 0
    assert toxicity.toxicity_table(docs, labels.where("false")).where("predicted = 1").count() == 0


def test_windows_of_words_equal_their_kernel(monkeypatch):
    rng = np.random.default_rng(14)
    machine = toxicity.Machine(rng.normal(size=64**3).astype(np.float32), 0.25)
    machine.weights[::64] = 0  # features that end in padding
    words = toxicity.spoken("Go! die-now, \u00fcber $$ 4 you " + "x" * 70 + " a b c d e f \U0001f600 end", {})
    phrases = list(toxicity.phrases_in(words))
    margin, first, size = toxicity.window_margins(machine, words)
    assert ["\x03\x02".join(words[a : a + k]) for a, k in zip(first, size)] == phrases and "go\x03\x02dienow" in phrases
    assert np.allclose(margin, machine.margins(phrases), atol=1e-4)
    whole = toxicity.phrase_margins(machine, [" ".join(words), "one", None, ""], {})
    assert np.isclose(whole[0], margin.max()) and (whole[1:] == 0.25).all()
    several = ["red blue", " ".join(words), None, "one", "go die now then", "red blue"]  # no window spans two texts
    assert np.allclose(toxicity.phrase_margins(machine, several, {}), [toxicity.phrase_margins(machine, [t], {})[0] for t in several])
    monkeypatch.setattr(toxicity, "STRETCH", 6)
    assert {p for part in toxicity.stretches(words) for p in toxicity.phrases_in(part)} == set(phrases)
    assert np.allclose(toxicity.phrase_margins(machine, [" ".join(words)], {}), whole[:1])


def test_insults_of_harmless_words_are_learnt(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice(["ta", "lo", "ri", "me", "nu"]) for _ in range(rng.randrange(1, 5)))
    texts = []
    for i in range(900):
        w = [word() for _ in range(30)]
        at = rng.randrange(len(w))
        if i % 3 == 0:
            w[at:at] = ["go", "die", "now"]
        else:
            for x in ("now", "go", "die"):  # the same words, apart
                w.insert(rng.randrange(10) * 3 + {"now": 0, "go": 1, "die": 2}[x], x)
                w.insert(0, word())
        texts.append(" ".join(w))
    texts = [t if i % 3 == 0 or not any(p in t for p in ("go die", "die now")) else " ".join(word() for _ in range(30)) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity_table(docs_of(spark, texts), labels).collect() if r["held_out"]]
    toxic = [r for r in held if r["doc_id"] % 3 == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in held if r["doc_id"] % 3) <= 0.02 * len(held)
    machine = toxicity.fit(docs_of(spark, texts), labels)
    gapped = docs_of(spark, ["ta lo go d-i-e now ri", "ta lo go diie now ri", "ta lo riri menu"])
    assert [r["predicted"] for r in toxicity.score(gapped, machine).orderBy("doc_id").collect()] == [1, 1, 0]


def test_bad_words_quoted_in_clean_rows_are_still_learnt(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ta", "lo", "ri", "me", "nu"]) for _ in range(rng.randrange(1, 5)))
    insults = ["blockhead", "scoundrel", "numbskull"]
    quotes = [i for i in range(600) if i % 3 and zlib.crc32(str(i).encode()) % 5][:30]
    texts = [" ".join([word() for _ in range(30)] + [rng.choice(insults)] * (i % 3 == 0) + [insults[i % 30 % 3]] * (i in quotes[::3])) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    held = toxicity.toxicity_table(docs_of(spark, texts), labels).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)


def test_witnesses_go_by_rate():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(200)]
    toxic = [rng.sample(words, 20) + ["insult"] for _ in range(100)]
    clean = [rng.sample(words, 20) + ["insult"] * (i < 2) for i in range(300)]
    counts = Counter(w for b in clean for w in b)
    assert toxicity.witnesses(toxic, counts, len(clean)) == (["insult"], {"insult"})
    assert toxicity.witnesses(toxic, counts + Counter({"insult": 100}), len(clean)) == ([], set())


# ---------------------------------------------------------------- n-gram join
def plain_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [{j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *[comp[j] for j in links[i]]]) for i in range(len(rows))]
    return links, comp


def near_copies(rng, n, group):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randrange(4, 90))) for _ in range(n)]
    base = [word() for _ in range(120)]
    for _ in range(group):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + texts[:5] + [t.upper() for t in texts[:3]]


def test_join_equals_brute_force(spark):
    texts = near_copies(random.Random(12), 60, 90) + [None, "", "  ", "one two", "one two", "one  two", LONG, LONG + "x"]
    rows = list(enumerate(texts))
    links, comp = plain_links(rows)
    df = docs_of(spark, texts).withColumn("same", __import__("pyspark").sql.functions.lit(1))
    for r in ngram_join.join_table(df).collect():
        i = r["doc_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), comp[i], comp[i] == i)


def test_join_of_odd_and_no_rows(odd, nothing):
    rows = ngram_join.join_table(odd).collect()
    assert len(rows) == len(ODD) + 1 and sum(r["kept"] for r in rows) == len(ODD) - 1
    assert {r["n_links"] for r in rows if r["doc_id"] in (11, 12)} == {2}
    assert ngram_join.join_table(nothing).count() == 0
    left = ngram_join.keep_one_of_each(odd)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1


def test_prefix_length_reaches_the_recall():
    k = ngram_join.prefix_length(0.8, 32, 10, 0.9999)
    assert 1 - (1 - 0.8**k) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (k + 1)) ** 32


def test_membership_products_equal_sets():
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    got = ngram_join.similar(sets, np.arange(8), np.arange(8, 20), 0.5 - 1e-9, columns=7)
    want = [[len(set(sets[i]) & set(sets[j])) >= (0.5 - 1e-9) * len(set(sets[i]) | set(sets[j])) for j in range(8, 20)] for i in range(8)]
    assert (got == np.array(want)).all()


# ---------------------------------------------------------------- chat
def test_escapes_are_reversible():
    rng = random.Random(14)
    parts = ["\\", "<", "|", "<|", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "a", "\n", "<|turn|>"]
    for _ in range(3_000):
        t = "".join(rng.choice(parts) for _ in range(6))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_examples_hold_context_and_one_reply(spark):
    rows = [
        (1, 2, "assistant", "B <|end|>"), (1, 1, "user", "A"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "last"),
        (2, 0, "system", "only"), (None, 1, "user", "q"), (None, 2, "assistant", "r"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (4, None, None, "n"), (4, 0, "assistant", "\\"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    ex = chat.expand(df)
    got = ex.where("conv_id = 1").orderBy("example").collect()
    assert [e["trainable"] for e in got] == [True, True, False]
    assert [chat.unescape(e["formatted"][e["loss_start"] : e["loss_end"]]) for e in got] == ["B <|end|>", "", ""]
    assert [(r, t) for r, t, _, _ in chat.read_turns(got[-1]["formatted"])] == [("user", "A"), ("assistant", "B <|end|>"), ("user", ""), ("assistant", ""), ("user", "last")]
    back = {r["conv_id"]: r for r in chat.read_back(ex).collect()}
    assert {k: v["n_turns"] for k, v in back.items()} == {1: 5, 2: 1, None: 2, 3: 2, 4: 2}
    assert back[3]["loss_sha256"] == hashlib.sha256(b"xx").hexdigest() and back[3]["loss_chars"] == 2
    assert back[4]["turns_sha256"] == hashlib.sha256("\nn\nassistant\n\\\n".encode()).hexdigest()
    shuffled = {r["conv_id"]: r for r in chat.read_back(ex.orderBy("loss_end").repartition(5)).collect()}
    assert shuffled == back and len(shuffled) == 5
    assert chat.read_back(chat.expand(df.where("false"))).count() == 0


def test_long_conversation_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_BYTES", 4_000)
    df = spark.range(300).selectExpr("id div 100 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat(cast(id as string), 20) as text")
    back = chat.read_back(chat.expand(df)).orderBy("conv_id").collect()
    assert [(r["n_turns"], r["n_examples"]) for r in back] == [(100, 50)] * 3


def test_long_conversations_are_dealt_out(spark):
    rows = [(None if i % 50 < 20 else i % 3, i, "assistant" if i % 4 in (1, 2) else "user", f"t{i}") for i in range(150)] + [(9, 1, "user", "x"), (9, 2, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.expand(df, block=7)
    got = sorted((str(r["conv_id"]), r["example"], r["formatted"], r["loss_start"], r["loss_end"], r["trainable"]) for r in ex.collect())
    want = []
    for conv in (None, 0, 1, 2, 9):
        prefix, n = "", 0
        own = [r for r in rows if r[0] == conv]
        for _, _, role, text in own:
            head = f"{prefix}{chat.TURN}{role}{chat.TEXT}"
            prefix = f"{head}{text}{chat.END}"
            if role == "assistant":
                want.append((str(conv), n, prefix, len(head), len(head) + len(text), True))
                n += 1
        if own[-1][2] != "assistant":
            want.append((str(conv), n, prefix, len(prefix), len(prefix), False))
    assert got == sorted(want)
    assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(ex).collect()} == {c: sum(r[0] == c for r in rows) for c in (None, 0, 1, 2, 9)}
