"""Each operator against brute force on small tables, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from strataframe.llm import common, decontaminate, html, langid, line_dedup, packing, quality_classifier, quality_rules, simhash, substring, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, body string, score double, g int"


def text_of(rnd, n, words=40):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    base = text_of(rnd, 120, 4000)
    out = [(i, text_of(rnd, rnd.randrange(1, 200), 3000), ["en", "fr"][i % 2]) for i in range(60)]
    out += [(100 + i, base, "en") for i in range(12)]  # copies
    out += [(200 + i, base + f" tail{i} end", "en") for i in range(12)]
    out += [(300, None, "en"), (301, "", None), (302, "  \n\t ", "en"), (303, "one", "en"), (303, "one", "en"), (None, base, None)]
    out += [(400, text_of(rnd, 30_000, 5000), "en"), (401, "x" * 9000, "fr")]
    return [(d, t, la, "s", 0, "r", "b", 0.5, 1) for d, t, la in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, i % 3 != 0 and 1 or 0, int(i % 5 == 1)) for i in ids] + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_xxh64_slices():
    rnd = np.random.default_rng(0)
    data = rnd.bytes(20_000)
    starts, lens = rnd.integers(0, 15_000, 400), rnd.integers(0, 5000, 400)
    lens[:200] %= 40
    got = common.xxh64_slices(data, starts, lens)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lens, strict=True)]


def test_quality_rules(docs, labels, rows, empty):
    got = [r for r in quality_rules.quality_rules(docs, labels).collect()]
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    for d, t, *_ in rows:
        w = words(t)
        n, seen = len(w), {}
        for i in range(n - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = by[d, n]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)
        )
        assert r.base_failed == (n < 50 or 100 * len(cover) > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty, labels.limit(0)).count() == 0


def spark_pair_hash(a, b):
    """Spark's xxhash64 of two strings' hashes, one after the other."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (a, b)]
    return xxhash.xxh64_intdigest(h[1].to_bytes(8, "little"), xxhash.xxh64_intdigest(h[0].to_bytes(8, "little"), 42))


@pytest.mark.parametrize("quantile", [0.2, 0.5])
def test_quality_verdict_against_brute_force(spark, quantile):
    rnd = random.Random(21)
    rows = [(i, text_of(rnd, rnd.randrange(20, 200), 300 if i % 3 else 80), int(i % 3 > 0)) for i in range(60)] + [(70, None, 1), (71, "", 0), (5, "an id twice " * 30, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2 == 0 and r[0] < 60] + [(None, 1), (8, None)], "doc_id bigint, quality int")
    got = sorted((r.doc_id, r.n_words, round(r.score, 5), r.kept, r.base_failed) for r in quality_rules.quality_rules(docs, labels, buckets=64, quantile=quantile, slack=0.01).collect())
    trusted = {r[0] for r in rows if r[0] % 2 == 0 and r[0] < 60 and r[2] == 1}
    cells = [[spark_pair_hash(a, b) % 64 for a, b in zip(w, w[1:], strict=False)] for w in (words(r[1]) for r in rows)]
    raw, target = np.zeros(64), np.zeros(64)
    for r, c in zip(rows, cells, strict=True):
        np.add.at(raw, c, 1)
        if r[0] in trusted:
            np.add.at(target, c, 1)
    ratio = np.round(np.log((target + 1) / (target.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64)), 6)
    score = [ratio[c].sum() / max(len(c), 1) for c in cells]
    cut = np.quantile([s for s, r in zip(score, rows, strict=True) if r[0] in trusted and len(words(r[1])) >= 50], quantile) - 0.01
    exp = []
    for r, s in zip(rows, score, strict=True):
        n = len(words(r[1]))
        base = next(g[4] for g in got if g[0] == r[0] and g[1] == n)
        exp.append((r[0], n, round(float(s), 5), not base and bool(s >= cut), base))
    assert got == sorted(exp) and 0 < sum(g[3] for g in got) < 55
    alone = quality_rules.quality_rules(docs, labels.where("quality = 5")).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in alone)


def test_quality_rules_learn_from_all_trusted_rows(spark):
    """With the least score of the trusted rows as threshold none of them is left out, however many there are."""
    rnd = random.Random(12)
    texts = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(52))) for i in range(40_000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "1 as quality")
    got = quality_rules.quality_rules(docs, labels, quantile=0.0, slack=0.0)
    assert got.where("not base_failed and not kept").count() == 0
    # Trusted and raw text are the same, and all of it is counted: the ratio says nothing.
    assert got.selectExpr("max(abs(score))").first()[0] < 1e-9


def test_trusted_rows_are_told_without_exchanging_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i // 2, text_of(rnd, 2000, 5000)) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "a b")], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 3 and 1) for i in range(100)] + [(None, 1)], "doc_id bigint, quality int")
    store = spark.sparkContext._jsc.sc()

    def run():
        written = lambda: sum(store.statusStore().executorList(False).apply(0).totalShuffleWrite() for _ in [store.listenerBus().waitUntilEmpty()])
        before = written()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.score, 6), r.kept) for r in quality_rules.quality_rules(docs, labels, buckets=64).collect())
        return got, written() - before

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = common.saved(docs, "docs")
        sent, size = run()
        assert len(sent) == 201 and size < 200_000  # of 400,000 pairs
        monkeypatch.setattr(quality_rules, "MARK_WORDS", 0)
        exchanged, more = run()
        assert exchanged == sent and more > size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("quantile", [0.0, 0.002, 0.3, 0.5, 1.0])
def test_quantile_against_numpy(spark, monkeypatch, quantile):
    monkeypatch.setattr(quality_rules, "RANGES", 4)
    rnd = random.Random(3)
    for values in ([], [1.5], [2.0] * 7, [rnd.gauss(0, 1) for _ in range(301)], [0.0] * 50 + [1e-300, 1.0, 1.0 + 2**-52] + [rnd.choice([-3.0, 7.0]) for _ in range(50)]):
        got = quality_rules.quantile_of(spark.createDataFrame([(v,) for v in values], "score double"), quantile)
        assert got is None if not values else got == pytest.approx(float(np.quantile(values, quantile)), abs=1e-12)


def fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes):
    """nodes: (id, fingerprint); smallest id reachable by 3 bits or fewer."""
    seen = {}
    for start in range(len(nodes)):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            i = todo.pop()
            for j, (_, f) in enumerate(nodes):
                if j not in group and (f ^ nodes[i][1]).bit_count() <= 3:
                    group.add(j)
                    todo.append(j)
        ids = [nodes[i][0] for i in group if nodes[i][0] is not None]
        for i in group:
            seen[i] = min(ids) if ids else None
    return seen


def test_simhash(docs, rows, empty):
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    nodes = [(r[0], fingerprint(r[1])) for r in rows]
    comp = brute_components(nodes)
    assert got == sorted((d is None, d, f"{f:016x}", comp[i]) for i, (d, f) in enumerate(nodes))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_are_complete(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        for bits in (1, 2, 3, 3, 3, 4):
            g = f
            for b in rnd.sample(range(64), bits):
                g ^= 1 << b
            fps.add(g)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()]
    mask = 2**64 - 1
    exp = sorted((a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 3)
    assert sorted(got) == exp


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 300), (200, 300), (5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 300: 100, 200: 100}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_path())
    got = packing.pack_documents(docs).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens, r.ids_crc32 if r.doc_tokens == r.length else None), []).append(r)
    left = sorted(((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str)
    exp = []
    for d, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            exp.append((d is None, d, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)))
    assert left == sorted(exp, key=str)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_shortest_pack_first():
    rnd = random.Random(4)
    hist = {n: rnd.randrange(1, 50) for n in rnd.sample(range(1, 2048), 300)}
    back = {}
    for n, pattern in packing.shortest_pack_first(hist):
        assert sum(pattern) <= 2048
        for length in pattern:
            back[length] = back.get(length, 0) + n
    assert back == hist


def test_shortest_pack_first_fills_new_packs():
    packs = lambda h: sum(n for n, _ in packing.shortest_pack_first(h))
    assert packs({100: 100_000}) == 5000 and packs({1: 100_000}) == 49 and packs({2048: 3, 1024: 5}) == 6
    rnd = random.Random(5)
    hot = {n: rnd.randrange(100, 200) for n in range(200, 501)} | {200: 33_000}
    assert packs(hot) < 1.03 * sum(k * n for k, n in hot.items()) / 2048


def test_packing_of_equal_short_texts(spark):
    made = [(i, "one and the same text" if i % 3 else None) for i in range(3000)]
    got = packing.pack_documents(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert len(got) == 3000 and max(ends.values()) <= 2048 and len(ends) == -(-sum(r.length for r in got) // 2048)
    empties = spark.range(5000).selectExpr("id doc_id", "'' text")
    assert packing.pack_documents(empties).select("sequence_id").distinct().count() == 3


def test_word_tokenizer_equals_the_library():
    tok = packing.WordTokenizer(packing.public_path())
    hard = ["I'll DON'T ÉCLAIŔ x²½ Ⅷ 'S İstanbul ΣΑΣ a\xa0b 日本語 mixed日本 <|endoftext|> a<|startoftext|>b 12ab_c--d", "", " \n", "\t\x0b a\x0cb\r"]
    assert [list(x) for x in tok.ids_of(hard)] == [tok.tok.encode(t, add_special_tokens=False).ids for t in hard]
    letters = random.Random(3)
    mixed = ["".join(letters.choices("aZ'stredlm019 .,-<|>éÉßſİŉΣσ\u0301 \x1c\t\n日end", k=letters.randrange(30))) for _ in range(3000)]
    for at in range(0, len(mixed), 100):  # one text's words must not change another's
        assert [list(x) for x in tok.ids_of(mixed[at : at + 100])] == [tok.tok.encode(t, add_special_tokens=False).ids for t in mixed[at : at + 100]]


def test_forward_sums_all_segmentations():
    p = langid.Pieces(["▁", "a", "b", "ab", "▁a", "▁ab"])
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.25]])[np.argsort(np.argsort(["▁", "a", "ab", "b", "▁a", "▁ab"]))]
    prob = dict(zip(p.pieces, table[:, 0], strict=True))

    def brute(w):
        return 1.0 if not w else sum(prob[w[:k]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in prob)

    for w in ("ab", "aab", "b", "abab"):
        assert np.isclose(np.exp(langid.score_words([w], p, table)[0, 0]), brute("▁" + w))


def test_long_words_against_all_segmentations():
    from itertools import product

    names = ["▁", "a", "b", "ab", "aba", "▁a", "bb"]
    p = langid.Pieces(names)
    rnd = np.random.default_rng(3)
    table = rnd.random((p.n, 2)) / 5
    prob = {n: table[i] for i, n in enumerate(p.pieces)}

    def brute(w):
        sums = [np.ones(2)]
        for j in range(1, len(w) + 1):
            s = sum((sums[j - k] * prob[w[j - k : j]] for k in range(1, j + 1) if w[j - k : j] in prob), np.zeros(2))
            sums.append(s + (0 if w[j - 1] in prob else sums[j - 1] * langid.FLOOR))
        return np.log(sums[-1])

    for n in range(1, 9):
        for letters in list(product("abc", repeat=n))[:80]:
            w = "".join(letters)
            assert np.allclose(langid.score_words([w], p, table)[0], brute("▁" + w))
            assert np.allclose(langid.score_long("▁" + w, p, table), brute("▁" + w))
    word = "".join(rnd.choice(list("abbac"), 60))
    assert np.allclose(langid.score_words([word], p, table)[0], brute("▁" + word))
    assert np.isfinite(langid.score_words(["ab" * 20_000], p, table)).all()


def test_expectation_maximisation_against_listed_segmentations():
    p = langid.Pieces(["▁", "a", "b", "ab", "▁a"])
    words, counts = ["▁ab", "▁b", "▁aab"], np.array([[3.0], [1.0], [2.0]])

    def cuts(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in p.pieces for rest in cuts(w[k:])]

    prob = {x: 1 / p.n for x in p.pieces}
    for _ in range(3):
        soft = dict.fromkeys(p.pieces, 0.01)
        for w, (n,) in zip(words, counts, strict=True):
            each = [(c, np.prod([prob[x] for x in c])) for c in cuts(w)]
            for c, v in each:
                for x in c:
                    soft[x] += n * v / sum(v for _, v in each)
        prob = {x: v / sum(soft.values()) for x, v in soft.items()}
    assert np.allclose(langid.fit(words, counts, p)[:, 0], [prob[x] for x in p.pieces])


def test_language_on_hard_rows(spark, docs, rows, empty):
    got = langid.identify_language(docs).collect()
    assert len(got) == len(rows) and all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (300, 301, 302))
    same = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len({same[100 + i] for i in range(12)}) == 1 and all(0 <= r.score <= 1 for r in got)
    long_run = [(1, "日本語" * 3000, "ja"), (2, "the cat and the dog " * 2000, "en"), (3, "the cat", "en"), (4, "日本", "ja"), (None, "dog", None)]
    d = spark.createDataFrame(long_run * 4, "doc_id bigint, text string, lang string")
    assert langid.identify_language(d).count() == 20
    assert langid.identify_language(d.withColumn("lang", d.lang.substr(1, 0)).where("false")).count() == 0


def test_language(spark, empty):
    rnd = random.Random(6)
    en, fr = "the of and to in is that for it with".split(), "le de et la les des que une dans pour".split()
    made = [(i, " ".join(rnd.choice((en, fr)[i % 2]) for _ in range(60)), ("en", "fr")[i % 2]) for i in range(200)]
    df = spark.createDataFrame([*made, (500, None, "en"), (501, "12 34 !!", "fr")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_language(df).collect()}
    assert all(got[i].lang_pred == la for i, _, la in made)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in made)
    assert (got[500].lang_pred, got[500].score, got[501].lang_pred) == ("und", 0.0, "und")
    assert langid.identify_language(empty).count() == 0


def test_quality_classifier(spark, docs, labels, rows, empty):
    rnd = random.Random(7)
    made, marks = [], []
    for i in range(300):
        w = [rnd.choice("the of and land house river green walk small under".split()) for _ in range(80)]
        bad = i % 4 == 0
        made.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        marks.append((i, 0 if bad else 1))
    d, m = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_classifier.score_quality(d, m).collect()}
    assert np.mean([got[i].predicted == q for i, q in marks if got[i].held_out]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept = quality_classifier.keep_good(d, m)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality_classifier.score_quality(docs, labels).count() == len(rows)
    assert quality_classifier.score_quality(empty, labels.limit(0)).count() == 0


def test_quality_scores_on_hard_rows(docs, labels, rows):
    import math

    got = quality_classifier.score_quality(docs, labels).collect()
    good, bad, slope, offset = quality_classifier._model(docs, labels, 4, 2, quality_classifier.PER_CLASS)
    c = quality_classifier.Compressors(good, bad)

    def score(t):
        raw = (t or "").encode()
        sizes = [sum(len(z.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for z in (c.good, c.bad)]
        return 1 / (1 + math.exp(-(slope * (sizes[1] - sizes[0]) / max(len(raw), 1) + offset)))

    exp = sorted((str(d), zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2, round(score(t), 9)) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 9)) for r in got) == exp
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def removal(rows):
    first, out = {}, []
    key = lambda d: 2**63 - 1 if d is None else d
    for d, t, *_ in sorted(rows, key=lambda r: key(r[0])):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), key(d))
    for d, t, *_ in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(d) for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring(docs, rows, empty):
    for group in (7, 1000):
        got = substring.remove_repeats(docs, group_docs=group).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, substring.sha256_of(r.kept_text)) for r in got) == removal(rows)
    assert substring.remove_repeats(empty).count() == 0


def test_substring_three_levels(spark):
    rnd = random.Random(8)
    passage = text_of(rnd, 60, 10_000)
    made = [(i, f"{text_of(rnd, 20, 10_000)} {passage} {text_of(rnd, 20, 10_000)}") for i in range(6)]
    got = substring.remove_repeats(spark.createDataFrame(made, "doc_id bigint, text string"), window=30)
    assert substring.levels_of(30) == [4, 8, 15, 30]
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0] + [60] * 5


def test_langid_rare_language_keeps_its_words(spark):
    made = [(i, f"the house and the garden of the king number{'abcdefgh'[i % 8]} stood there", "en") for i in range(80)]
    made += [(100 + i, "żółw śpiewa", "pl") for i in range(3)]
    d = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    langs, _, table = langid.train(d, train_words=8)
    alone = langid.train(d.where("lang = 'pl'"), train_words=8)[2]
    assert langs == ["en", "pl"] and np.allclose(table[:, 1], alone[:, 0]) and table[:, 1].max() > 10 * np.median(table[:, 1])


PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One<br>two   <b>three</b></p><p>Four<form><input><p>name</form></article>
<aside>more</aside><div id="comments"><p>nice</p></div><footer>&copy;</footer></body></html>"""


def test_extract():
    assert html.extract(PAGE) == "A & B\nOne two three\nFour"
    assert html.extract(None) == html.extract("") == ""
    assert html.extract("<p>plain<p>text") == "plain\ntext"
    assert html.extract("<div>a<!-- <p>no</p> -->b</div><script>x") == "ab"
    assert html.extract("<main><p>a</p></main><div><p>second half of the story</p></div>") == "a\nsecond half of the story"
    assert html.extract("<article><div class=related>kept</div><div class=ad>no</div><p>a</p></article><div class=related>no</div>") == "kept\na"
    assert html.extract("a<hr>b<wbr>c < d <!-- e") == "a\nbc < d"
    assert html.extract("<p>a</p><button>b<p>c</p>") == "a\nb\nc"


def test_odd_pages_take_linear_time():
    import time

    for page in ("<a " * 350_000, "<a \"" * 200_000 + ">", "<div>" * 60_000 + "x", "<button>" * 60_000, "</p><b>" * 60_000, "<!--" * 250_000, "<p title='" * 100_000 + "<p>x"):
        began = time.time()
        html.extract(page)
        assert time.time() - began < 5


def random_tree(rnd, size, texts):
    t = html.Tree()
    t.add("#root", -1)
    open_ = [0]
    while len(t.tag) < size:
        up = rnd.choice(open_[-3:])
        while open_[-1] != up:
            open_.pop()
        if rnd.random() < 0.5:
            t.add("#", up, rnd.randrange(1, texts))
        else:
            open_.append(t.add(rnd.choice(["div", "p"]), up))
    return t.finish()


def brute_weight(a, i, b, j):
    if a.tag[i] != b.tag[j]:
        return 0
    x, y = a.kids[i], b.kids[j]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for r, p in enumerate(x, 1):
        for c, q in enumerate(y, 1):
            m[r][c] = max(m[r - 1][c], m[r][c - 1], m[r - 1][c - 1] + brute_weight(a, p, b, q))
    return 1 + m[-1][-1] + (a.tag[i] == "#" and a.text[i] == b.text[j])


def test_tree_matching_against_brute_force(monkeypatch):
    rnd = random.Random(16)
    for cells in (10**6, 6):  # whole tables, and tables in halves
        monkeypatch.setattr(html, "CELLS", cells)
        for _ in range(150):
            texts = rnd.choice([3, 8, 100])
            a, b = random_tree(rnd, rnd.randrange(1, 25), texts), random_tree(rnd, rnd.randrange(1, 25), texts)
            pairs = html.match(a, b)
            best = brute_weight(a, 0, b, 0)
            assert html.Matching(a, b).weight(0, 0) == best
            assert sum(1 + (a.tag[i] == "#" and a.text[i] == b.text[j]) for i, j in pairs) == best
            of = dict(pairs)
            assert len(of) == len(pairs) == len(set(of.values())) and of[0] == 0
            for i, j in pairs:
                assert a.tag[i] == b.tag[j] and (i == 0 or of[a.up[i]] == b.up[j])
            order = sorted(pairs)
            assert all(p[1] < q[1] for p, q in zip(order, order[1:], strict=False))  # page order is kept


def test_wrapper_induction(spark):
    make = lambda k: f"<body><div><p>Our motto</p></div><div><p>story {k}</p><p>body {k * 7}</p></div></body>"
    rows = [(i, "http://a.example/x", make(i), "h") for i in range(20)] + [(50, None, None, "h"), (51, "nonsense", "<p>x</p>", "h"), (3, "http://a.example/x", make(3), None), (3, "http://a.example/x", make(99), "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    for most in (10**6, 0):  # templates sent to the workers, or joined
        got = html.extract_pages(df, broadcast_bytes=most).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == 24 and by[4] == "story 4\nbody 28" and by[50] == "" and by[51] == "x"
        assert sorted(r.text for r in got if r.page_id == 3) == ["story 3\nbody 21"] * 2 + ["story 99\nbody 693"]
        assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract_pages(df.limit(0)).count() == 0
    assert html.extract_pages(df.where("html is null")).collect()[0].text == ""


def blind(page):
    """Without class names and with divs for article and main."""
    import re

    return re.sub(r"<(/?)(?:article|main|nav|footer|header|aside)\b", r"<\1div", re.sub(r' class="[^"]*"', "", page))


def test_template_decides_without_marks(spark):
    rnd = random.Random(17)

    def make(k):
        story = "".join(f"<p>{text_of(rnd, 12, 10**6)}</p>" for _ in range(rnd.randrange(1, 6)))
        return (
            f'<body><header>Site name</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li></ul></nav><div class="ad">Buy now</div>'
            f'<article><h1>{text_of(rnd, 5, 10**6)}</h1>{story}<div class="share">Share this</div></article><aside>All rights reserved</aside><footer>About us</footer></body>'
        )

    pages = [make(k) for k in range(24)]
    rows = [(i, "http://one.example/x", p) for i, p in enumerate(pages)] + [(100 + i, "http://two.example/x", blind(p)) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    import re

    for i, p in enumerate(pages):
        want = "\n".join(re.findall(r"<(?:h1|p)>(.*?)</", p))
        assert got[i] == want and got[100 + i] == want


def test_repeated_passages_of_articles_stay(spark):
    rows = [(i, "http://one.example/x", f"<body><article><h1>title {i}</h1><p>A passage that some pages share.</p><p>own words {i}</p></article></body>") for i in range(3)]
    rows += [(3 + i, "http://one.example/x", f"<body><article><h1>title {3 + i}</h1><p>other words {i}</p></article></body>") for i in range(4)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sum("A passage" in r.text for r in got) == 3


def test_wrappers_of_small_hosts_and_layouts(spark):
    rows = []
    for host in range(40):  # two pages each
        for i in range(2):
            rows.append((len(rows), f"http://h{host}.example/{i}", f"<body><div>Motto {host}</div><p>story {host} {i}</p></body>"))
    for i in range(50):  # two layouts of 60 and 40 in a hundred, and a rare one of 3 pages
        page = f"<body><div>Old motto</div><p>tale {i}</p></body>" if i % 5 < 3 else f"<body><section><div>New motto</div></section><div>Legal line</div><h2>tale {i}</h2></body>"
        rows.append((len(rows), "http://two.example/x", page))
    rows += [(len(rows) + i, "http://two.example/y", f"<body><table><tr><td>Rare motto<td>tale r{i}</table></body>") for i in range(3)]
    rows += [(1000 + i, "http://copies.example/x", "<body><p>said once</p></body>") for i in range(3)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows) and not [r.text for r in got if "otto" in r.text or "Legal" in r.text]
    assert all(r.text.startswith(("story", "tale", "said")) for r in got)


def test_templates_count_all_pages(spark):
    """A line on 26 of 50 pages of a host is a constant, one on 25 is none, whichever pages have the least hashes; few votes and small parts tell the same."""
    page = lambda h, i: f"<html><body><div><p>{'Seen on most pages' if i < h else f'line {i}'}</p></div><section><p>text {i}</p></section></body></html>"
    rows = [(f"h{h}", page(h, i)) for h in range(22, 30) for i in range(50)]
    src = spark.createDataFrame(rows, "host string, html string")
    for options in ({}, {"votes": 2, "part": 7}, {"votes": 4, "part": 20}):
        got = {r.host for r in html.templates(src, **options).where("scope = 0").collect()}
        assert got == {"h26", "h27", "h28", "h29"}, options


def test_pages_of_one_layout_are_merged_once_and_in_place(spark, monkeypatch):
    page = lambda i: "<body><p>Our motto</p>" + "".join(f"<p>text {i} {k}</p>" for k in range(i % 20 + 1)) + "<div>Legal line</div></body>"
    trees = [html.tree_of(page(i))[0] for i in range(200)]
    made = []
    add = html.Tree.add
    monkeypatch.setattr(html.Tree, "add", lambda self, *a: made.append(1) or add(self, *a))
    m = html.merged_all([html.Merged.of(t) for t in trees])
    assert len(made) < 5 * len(m.tree.tag)  # not the whole tree again for each page
    assert sorted(x for x in html.constants_of(m)[0] if x) == sorted([html._hash(x)] for x in ("Our motto", "Legal line"))
    monkeypatch.undo()
    rows = [("one", page(i)) for i in range(60)]
    rows += [("two", f"<body><div>Motto {i % 2}</div>" + ("<section><p>x</p></section>" if i % 2 else "") + f"<p>tale {i}</p></body>") for i in range(60)]
    src = spark.createDataFrame(rows, "host string, html string")
    for options in ({}, {"part": 20}, {"votes": 2}, {"votes": 2, "part": 20}):
        got = [(r.host, r.scope == 0) for r in html.templates(src, **options).collect()]
        assert sorted(got) == [("one", True), ("two", False), ("two", False), ("two", True)], options


def test_merging_with_names_kept_or_made_anew(monkeypatch):
    rnd = random.Random(23)
    for _ in range(40):
        base = random_tree(rnd, 30, 6)
        trees = [random_tree(rnd, rnd.randrange(2, 30), 6) for _ in range(3)]
        for _ in range(12):
            t = base.only([True] * len(base.tag))
            t.text = [x and rnd.choice([x, rnd.randrange(1, 6)]) for x in t.text]
            trees.append(t)
        rnd.shuffle(trees)
        texts, told = [list(t.text) for t in trees], []
        for names in (0, 10**6):
            monkeypatch.setattr(html, "NAMES", names)
            m = html.merged_all([html.Merged.of(t) for t in trees], 3)
            told.append((m.tree.tag, m.tree.up, m.tree.text, m.count, m.lost, m.seen))
        assert told[0] == told[1] and texts == [t.text for t in trees]  # the pages' own trees stay as they are
        assert m.count[0] == len(trees) and sum(m.count) == sum(len(t.tag) for t in trees)
        assert all(lost or n == sum(c.values()) for n, c, lost, tag in zip(m.count, m.seen, m.lost, m.tree.tag, strict=True) if tag == "#")


def test_wrapper_at_the_end_of_long_pages(spark):
    make = lambda k, n: "<body>" + "".join(f"<div><p>row <i>{k}</i> of <b>{j}</b></p></div>" for j in range(n)) + "<div>Legal line</div></body>"
    rows = [(i, "http://long.example/x", make(i, 900 if i % 4 else 2)) for i in range(12)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 12 and all(r.text.count("\n") == (899 if r.page_id % 4 else 1) and "Legal" not in r.text for r in got)


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers():
    rnd = random.Random(9)
    for _ in range(100):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60)))
        assert decontaminate.myers(p, t, 100) == edit_distance(p, t)


def test_decontamination(spark, docs, rows, empty):
    rnd = random.Random(10)
    items = [(i, text_of(rnd, 40, 9000)) for i in range(8)] + [(8, None), (9, "  ")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    near = items[1][1].replace("w1", "v1", 1).upper()
    made = [(1, f"start {items[0][1]} end"), (2, f"a {near} b"), (3, text_of(rnd, 80, 9000)), (4, None), (5, "")]
    d = spark.createDataFrame(made, "doc_id bigint, text string")
    for block in (10, 10**6):
        got = {r.doc_id: r for r in decontaminate.contamination(d, bench, block_chars=block).collect()}
        assert got[1].item_ids == [0] and got[1].distances == [0] and got[2].item_ids == [1]
        assert [got[i].contaminated for i in (3, 4, 5)] == [False] * 3
        for i, t in made:
            norm = decontaminate.normalised(t)
            exp = []
            for k, x in items:
                x = decontaminate.normalised(x)
                if x and (e := edit_distance(x, norm)) <= int(0.07 * len(x)):
                    exp.append((k, e))
            assert list(zip(got[i].item_ids, got[i].distances, strict=True)) == exp
    assert decontaminate.keep_clean(docs, bench).count() == len(rows)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(d, bench.limit(0)).where("contaminated").count() == 0


def test_line_dedup(spark, docs, rows, empty):
    made = []
    for i in range(15):
        made.append((i, f"own line number {i} of text {i * 3}x only here {i}\nThis page was printed for all readers today\nuser {i} logged in from host alpha{i}\nto be", "a"))
    made += [(50, None, "b"), (51, "", "c"), (52, "This page was printed for all readers today", "d"), (0, made[0][1], "a")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, row string")
    got = sorted(line_dedup.line_dedup(df).collect(), key=lambda r: (r.doc_id, r.n_dropped))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(made) and by[0].text == made[0][1] and by[0].n_dropped == 0
    assert all("printed" not in by[i].text and "logged in" not in by[i].text and by[i].text.endswith("to be") for i in range(1, 15))
    assert by[50].text is None and by[51].text == "" and by[52].text == "" and by[52].n_dropped == 1
    out = line_dedup.rewritten(df)
    assert out.columns == df.columns and {r.row for r in out.collect()} == {"a", "b", "c", "d"}
    assert line_dedup.line_dedup(docs).count() == len(rows)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_generalises(spark):
    rnd = random.Random(11)
    made = [(i, f"{text_of(rnd, 9, 10**6)}\nThe door named {'abcdefghijklmnop'[i]}x opens to the north side") for i in range(14)]
    got = line_dedup.line_dedup(spark.createDataFrame(made, "doc_id bigint, text string")).orderBy("doc_id").collect()
    # The first lines are all variable fields: no template.
    assert [r.n_dropped for r in got] == [0] + [1] * 13


def test_line_dedup_against_sql(spark, rows):
    import duckdb
    import pandas as pd

    from strataframe.llm.queries import ORACLE_SQL

    rnd = random.Random(18)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    made = [(r[0], r[1]) for r in rows] + [(None, None), (None, "Read more"), (9, "two\n\ntexts"), (9, "of one id")]
    base = [word() for _ in range(16)]
    families = [[word() for _ in range(14)] for _ in range(6)]
    for i in range(500, 900):
        lines = [" ".join(word() for _ in range(rnd.randrange(1, 9)))]
        copy = ["In", "this", "issue", *base]  # near copies in one leaf
        copy[3 + rnd.randrange(16)] = word() if rnd.random() < 0.7 else rnd.choice(base)
        lines.append(" ".join(copy))
        f = families[rnd.randrange(6)]  # families that share a leaf, each with fields of its own
        lines.append(" ".join(["We", "all", "know", *(w if (k + len(f[0])) % 3 else word() for k, w in enumerate(f))]))
        lines.append(f"Seite {i} von {rnd.randrange(99)}  am\t{rnd.randrange(30)}. Mai" if i % 2 else "© " + word())
        lines.append(rnd.choice(["Read more", "", "   ", "to be or not", "* * * *", f"{i} 7"]))
        rnd.shuffle(lines)
        made.append((i, "\n".join(lines)))
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    got = sorted(map(repr, (tuple(r) for r in line_dedup.line_dedup(df).collect())))
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(made, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.execute("create view documents as select doc_id, text from frame")
    exp = sorted(map(repr, con.execute(ORACLE_SQL["op9_line_dedup"]).fetchall()))
    assert got == exp
    assert sum(r.n_dropped for r in line_dedup.line_dedup(df).collect()) > 700


def test_line_dedup_variable_fields(spark):
    fields = [
        "Page {0} of {1} in total",
        "Posted on {0} March {1} at 10:{0}",
        "2021-03-{0} 12:00:{1} user {0} logged in from 10.0.0.{1}",
        "Views {1} | Likes {0} | Shares 4{0}",
        "| {0} | {1} | 3{1} | 4{0} |",  # no words: numbers of a table
    ]
    made = [(i, "\n".join(f.format(i + 10, i * 37 + 5) for f in fields) + "\n10 20 30 40 50") for i in range(12)]
    got = line_dedup.line_dedup(spark.createDataFrame(made, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert got[0].n_dropped == 0 and [r.text for r in got[1:]] == [t.split("\n")[4] for _, t in made[1:]]


def test_line_dedup_families_in_one_leaf(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    made = []
    for i in range(90):
        if i < 15:
            line = f"In the city {word()} was named the winner of prizes for her last book"
        elif i < 30:
            line = f"In the city our partner {word()} sells tickets to all shows by {word()} now online"
        else:
            line = "In the city " + " ".join(word() if rnd.random() < 0.6 else rnd.choice(["the", "of", "and"]) for _ in range(11))
        made.append((i, f"{word()} {word()} {word()} {word()}\n{line}"))
    for i in range(90, 105):  # each has another token at another place
        line = "We thank all readers who sent their kind letters to us this long year".split()
        line[3 + i % 11] = word()
        made.append((i, " ".join(line)))
    got = line_dedup.line_dedup(spark.createDataFrame(made, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0] + [1] * 14 + [0] + [1] * 14 + [0] * 60 + [0] + [1] * 14


def test_line_dedup_by_length(spark):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = {2: line(60), 3: line(30), 9: line(10), 12: "这是一个没有空格的句子，每页都有。", 100: "Read more", 99: "Go on", 101: "17"}
    made = [(i, "\n".join([line(6)] + [t for n, t in shared.items() if i < n])) for i in range(110)]
    got = line_dedup.line_dedup(spark.createDataFrame(made, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert got[0].text == made[0][1]
    left = {n: sum(t in r.text.split("\n") for r in got) for n, t in shared.items()}
    assert left == {2: 1, 3: 1, 9: 9, 12: 1, 100: 1, 99: 99, 101: 101}


def test_line_dedup_checkpoints_few_files(spark):
    from pathlib import Path

    made = [(i, f"text {i} alone\nThe door named {'abcdefghijklmnop'[i % 16]}{i}x opens to the north side\nThis page was printed for all readers today") for i in range(60)]
    made += [(i, f"All shows of partner {'abcdefghijklmnopqrst'[i - 60]}y sell their tickets only online") for i in range(60, 80)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    few = sorted(map(tuple, line_dedup.line_dedup(df).collect()))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in names}
    root = Path(common.shared_folder(spark).removeprefix("file:"))
    files = lambda: set(root.rglob("rdd-*/part-*"))
    try:
        for k, v in zip(names, ("32", "false"), strict=True):
            spark.conf.set(k, v)
        old = files()
        many = sorted(map(tuple, line_dedup.line_dedup(df).collect()))
        new = files() - old
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert many == few and sum(r[3] for r in many) == 59 + 59 + 19
    # One for each core and checkpoint, about, whatever the number of shuffle partitions.
    assert 0 < len(new) <= 64


def test_toxicity(spark, docs, labels, rows, empty):
    rnd = random.Random(12)
    made, marks = [], []
    for i in range(800):
        w = [f"w{rnd.randrange(200)}" for _ in range(50)]
        if i % 8 == 0:
            w[rnd.randrange(50)] = rnd.choice(["vile", "Rotten!"])
        made.append((i, " ".join(w)))
        if i % 2 == 0:
            marks.append((i, int(i % 8 == 0)))
    d, m = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, m).collect()}
    assert np.mean([got[i].predicted == int(i % 8 == 0) for i in range(800) if got[i].held_out]) > 0.97
    assert toxicity.score_toxicity(docs, labels).count() == len(rows)
    assert toxicity.score_toxicity(empty, labels.limit(0)).count() == 0


def test_prior_from_positives_and_unlabelled_text():
    rnd = np.random.default_rng(5)
    names = [f"w{i}" for i in range(300)]

    def document(toxic):
        d = rnd.choice(250, 30, replace=False)
        return np.unique(np.r_[d, rnd.choice(np.arange(250, 300), 4)] if toxic else d).astype(np.int32)

    for prior in (0.05, 0.2):
        positive = [document(True) for _ in range(400)]
        unlabelled = [document(rnd.random() < prior) for _ in range(3000)]
        assert abs(toxicity.prior_of(positive, unlabelled, names) - prior) < 0.04
    assert toxicity.prior_of(positive[:3], unlabelled, names) == toxicity.FIRST_PRIOR


def test_toxicity_on_hard_rows(spark, docs, labels, rows):
    import math

    got = toxicity.score_toxicity(docs, labels).collect()
    held = {r[0] for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0}
    texts = docs.select("doc_id", common.text_or_empty().alias("text"))
    model = toxicity.train(texts.where("doc_id is not null").filter(~docs.doc_id.isin([i for i in held if i is not None])), labels.filter(~labels.doc_id.isin([i for i in held if i is not None])))
    assert {str(r.doc_id) for r in got if r.held_out} == {str(i) for i in held}
    weights, offset = model
    score = lambda t: 1 / (1 + math.exp(-(offset + sum(weights.get(w, 0.0) for w in toxicity.word_set(t or "")))))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(d), round(score(t), 6)) for d, t, *_ in rows)
    none = toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)


def test_stages_on_hard_rows(spark, docs, rows, empty):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    hard = docs.unionByName(spark.createDataFrame([(300, "another text of one id", None, None, None, None, None, None, None), (None, None, None, "s", 0, "r", "b", 0.5, 1)], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, hard, src), stage(spark, empty, src)
        assert none.count() == 0
        found = out.collect()
        if name == "pack":
            assert sum(r.start == 0 for r in found) == hard.count()
            continue
        assert out.columns == docs.columns and out.schema == docs.schema and len(found) <= hard.count()
        if name == "lines":
            assert len(found) == hard.count() and sum(r.text is None for r in found) == 2
        if name == "near_duplicates":
            fps = {fingerprint(r.text) for r in hard.collect()}
            assert len(found) == len({c for c in brute_components([(k, f) for k, f in enumerate(sorted(fps))]).values()})
        if name == "decontamination":
            assert len(found) == hard.count()


def test_near_duplicates_stage_with_repeated_and_missing_ids(spark):
    import corpus_pipeline

    rnd = random.Random(15)
    a, b, c, d = (text_of(rnd, 200, 10**6) for _ in range(4))
    made = [(1, a), (2, a), (5, a), (5, b), (5, b), (None, b), (None, c), (None, c), (7, d), (None, d), (9, None), (None, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(made, "doc_id bigint, text string"), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted([("1", a), ("5", b), ("None", c), ("7", d)])
    assert [(r.doc_id, r.text) for r in got if not r.text] == [(9, None)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = common.table(spark, src, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, src)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns
        if name == "quality":
            good = {r.doc_id for r in quality_classifier.score_quality(before, common.table(spark, src, "labels")).where("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        elif name == "lines":
            assert docs.count() == before.count()
        elif name == "near_duplicates":
            rows_ = [(r.doc_id, fingerprint(r.text)) for r in before.collect()]
            comp = brute_components(rows_)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for c in comp.values()})
        elif name == "decontamination":
            items = [decontaminate.normalised(r.text) for r in common.table(spark, src, "benchmark").collect()]
            kept = {r.doc_id for r in docs.collect()}
            held = {r.doc_id for r in before.collect() if any(x in decontaminate.normalised(r.text) for x in items)}
            assert not kept & held
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept


def _sizes(batches):
    """A row a batch, of the columns of documents: its bytes and rows."""
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([str(b.num_rows)])], names=["doc_id", "text"])


def _size_fingerprints(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["doc_id", "fp"])


def _size_pieces(batches):
    import pyarrow as pa

    for b in batches:
        rest = [pa.array([x], pa.int64()) for x in (b.nbytes, 0, 1, b.num_rows, 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([0], pa.int32())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontamination", "pack"])
def test_texts_reach_workers_in_bounded_batches(spark, stage, monkeypatch):
    """However long the texts are, a worker holds few bytes of them at a time; each row stays whole, one longer than the bound, too."""
    row, longest = 300_000, 5_000_000
    docs = spark.range(41, numPartitions=1).selectExpr("id as doc_id", f"if(id = 20, repeat('long ', {longest // 5}), repeat('word ', {row // 5})) as text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    items = spark.createDataFrame([(1, "an item of a benchmark")], "item_id bigint, text string")
    monkeypatch.setattr(quality_classifier, "_score_batches", lambda *_: _sizes)
    monkeypatch.setattr(decontaminate, "_match_batches", lambda *_: _sizes)
    monkeypatch.setattr(simhash, "_fingerprint_batches", _size_fingerprints)
    monkeypatch.setattr(packing, "_piece_batches", lambda *_: _size_pieces)
    run = {
        "quality": lambda: quality_classifier.keep_good(docs, labels),
        "near_duplicates": lambda: simhash.fingerprints(docs),
        "decontamination": lambda: decontaminate.keep_clean(docs, items),
        "pack": lambda: packing.pack_documents(docs),
    }[stage]
    spark.conf.unset(common.BATCH_BOUND)
    rows = [tuple(r) for r in run().collect()]
    counts = [int(r[3] if stage == "pack" else r[1]) for r in rows]
    assert sum(counts) == 41 and sum(r[0] for r in rows) >= 40 * row + longest
    long = [r for r in rows if r[0] >= longest]
    assert len(long) == 1 and long[0][0] < longest + common.BATCH_BYTES + row
    assert all(r[0] <= common.BATCH_BYTES + 2 * row for r in rows if r not in long)


def test_a_session_keeps_its_own_bound_of_batches(spark):
    docs = spark.range(40, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 20000) as text")
    spark.conf.set(common.BATCH_BOUND, "1m")
    try:
        rows = common.map_texts(docs, _sizes, "doc_id bigint, text string").collect()
        assert spark.conf.get(common.BATCH_BOUND) == "1m"
        assert max(r.doc_id for r in rows) < 1.3e6 and sum(int(r.text) for r in rows) == 40
    finally:
        spark.conf.unset(common.BATCH_BOUND)
