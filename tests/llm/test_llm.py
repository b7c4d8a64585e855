"""Each operator against a brute-force version, and on rows that are out of the ordinary."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strada.llm import bloom, cross_parse_langid, drr_packing, exact_dedup, fertility_quality, mvh_mixing, nnpu_toxicity, omh_dedup, pii_sanitise, queries, rlz_substring, sst_tokens
from strada.llm.components import components
from strada.llm.textblock import TextBlock, summed
from strada.llm.textblock import mix as mixed
from strada.llm.tokenise import Encoder
from strada.llm.wordcache import WordCache

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ren", "su", "tal") for b in ("do", "vi", "nek", "ru", "sha", "po", "gi")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=3, n=60):
    """Invented prose with exact copies, near copies, shared passages, and odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(n)]
    for k in range(0, n, 9):
        texts[k] = texts[k] + "\n" + passage
    texts += [texts[1], texts[1].replace(" ", "\n"), texts[2].replace(" ", "  ", 3)]
    for k in (3, 4, 5):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += ["", "   ", None, "one", "one two three", "same same same same " * 30, "日本語 テキスト", "x" * 3000, "a b " * 4000, None, "line\nline\nline"]
    return [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys, repeated rows, ties, and further columns whose names the operators use inside."""
    rows = [(1, "hello world " * 30, "en", "a"), (1, "hello world " * 30, "en", "a"), (None, None, None, None), (None, "hello world " * 30, None, "b"), (2, "", "en", "a"), (3, prose(random.Random(1), 90), "en", "b"), (-5, "x y z", "de", None)]
    base = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    for name in ("row", "h", "sha", "kept", "label", "source_size", "start", "text_sha256", "spans", "__text", "__h", "__maybe", "n", "key", "a.b"):
        base = base.withColumn(name, F.lit(name))
    return base


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words(text):
    return (text or "").encode().split()


# 1


def test_exact_dedup_against_brute_force(docs):
    groups = defaultdict(list)
    for i, t in texts_of(docs).items():
        groups[normal(t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.groups(docs).collect()}
    assert got == want
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])


def test_exact_dedup_odd_rows(spark, odd):
    got = exact_dedup.groups(odd).collect()
    assert len(got) == 7
    same = [r for r in got if r["group_size"] == 3]
    assert len(same) == 3 and all(r["keep_id"] is None for r in same)
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert exact_dedup.groups(empty(spark)).count() == exact_dedup.keep_first(empty(spark)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    twice = [k * 977 for k in range(500)]
    rows = spark.createDataFrame([(k,) for k in twice + twice + list(range(10**6, 10**6 + 3000))], "h long").repartition(5)
    mixed = rows.select(F.xxhash64("h").alias("h"))
    plane = bloom.repeated(mixed, bloom.bits_for(4000)).value
    again = np.array([r["h"] for r in spark.createDataFrame([(k,) for k in twice], "h long").select(F.xxhash64("h").alias("h")).collect()]).astype(np.uint64)
    alone = np.array([r["h"] for r in mixed.groupBy("h").count().where("count = 1").collect()]).astype(np.uint64)
    assert bloom.holds(plane, again).all()
    assert bloom.holds(plane, alone).mean() < 0.2


# 2


def shingles(text):
    w, count, out = words(text), Counter(), set()
    for k in range(len(w) - 4):
        g = tuple(w[k : k + 5])
        out.add((g, count[g]))
        count[g] += 1
    return out


def near_classes(texts):
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if words(texts[a]) == words(texts[b]) or common and common / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in texts}


def test_near_dedup_against_brute_force(docs):
    want = near_classes(texts_of(docs))
    got = {r["doc_id"]: r["class_id"] for r in omh_dedup.classes(docs).collect()}
    assert got == want
    kept = omh_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_dedup_of_one_large_family(spark):
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    assert {r["doc_id"]: r["class_id"] for r in omh_dedup.classes(df).collect()} == near_classes(texts)


def test_near_dedup_odd_rows(spark, odd):
    got = omh_dedup.classes(odd).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 4
    kept = omh_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert omh_dedup.classes(empty(spark)).count() == omh_dedup.keep_one(empty(spark)).count() == 0


def test_alignment_counts_only_what_runs_forward():
    a = np.arange(100, dtype=np.int32)
    assert omh_dedup.aligned(a, a) == 100
    assert omh_dedup.aligned(a, np.concatenate([a[:5], a[8:]])) == 97
    swapped = np.concatenate([a[3:6], a[:3], a[6:]])
    assert omh_dedup.aligned(a, swapped) == 97


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# 3


def toxic_rows(n=900):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        bad = i % 7 == 0
        w = prose(rng, rng.randint(30, 90)).split()
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilgor", "vilgora!", "Skumta", "skumtar"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    got = nnpu_toxicity.predict(df, marks, held).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    true = got["doc_id"] % 7 == 0
    out = got["held_out"]
    assert ((got["predicted"] == 1) == true)[out].mean() > 0.97
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    # labels of held-out rows make no difference
    other = marks.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = nnpu_toxicity.predict(df, other, held).toPandas()
    assert np.allclose(again.sort_values("doc_id")["score"], got.sort_values("doc_id")["score"])


def test_toxicity_odd_rows(spark, odd):
    marks = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert nnpu_toxicity.predict(odd, marks, F.lit(False)).count() == 7
    none = nnpu_toxicity.predict(odd, marks.where("toxic = 0"), F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert nnpu_toxicity.predict(empty(spark), marks, F.lit(False)).count() == 0


def test_corrected_risk_never_rewards_calling_all_clean():
    p = nnpu_toxicity.Sparse(np.repeat(np.arange(20), 2), np.tile([1, 2], 20), 20)
    u = nnpu_toxicity.Sparse(np.repeat(np.arange(200), 1), np.where(np.arange(200) < 20, 1, 3), 200)
    m = nnpu_toxicity.fit(p, u, 0.1)
    assert m.weights[1] + m.weights[2] + m.intercept > 0 > m.intercept


# 4


@pytest.mark.parametrize("name,end,spaces", [("byte_bpe_50k.json", 0, True), ("word_bpe_49k.json", 1, False)])
def test_pieces_of_words_are_the_same_as_whole_texts(name, end, spaces):
    path = queries.vocabulary_file(name)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    texts = ["", " ", "a", "  a", "a  b", "I'm 'test's ok!'s 12 3a\n\nx\n y", "\n", "naïve café—x", "<|endoftext|> hi", "İstanbul ΑΣ'S", "a\tb\tc", "tab\t\tx y\r\nz", "don't 'S It'S x'll'll", "x­y z", "!'s ...'re  x", "x.\ny", "x\n'll", "a1b2", *[t or "" for _, t, *_ in corpus()]]
    made = Encoder(path, end, spaces)
    for _ in range(2):
        ids, at = made.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [end], t


def test_shards_round_trip(docs, odd, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.byte_bpe().path)
    manifest = sst_tokens.write(docs, queries.byte_bpe())
    got, start = {r["doc_id"]: r for r in sst_tokens.read(spark, manifest).collect()}, 0
    for i, t in sorted(texts_of(docs).items()):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for m in manifest:
        with sst_tokens.open_shard(m["path"]) as f:
            shard = sst_tokens.Reader(f)
            keys = [k for k, _ in shard]
            assert keys == sorted(keys)
            assert all(len(shard.get(k)) == 1 for k in keys) and shard.get(10**9) == []
    repeated = sst_tokens.read(spark, sst_tokens.write(odd, queries.byte_bpe())).collect()
    assert len(repeated) == 7 and sum(r["doc_id"] is None for r in repeated) == 2
    assert sst_tokens.read(spark, sst_tokens.write(empty(spark), queries.byte_bpe())).count() == 0


def test_shard_of_many_blocks_and_repeated_keys(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sst_tokens.Writer(f, 2)
        for k in [None, -7, *range(40)]:
            for rep in range(3 if k == 20 else 1):
                w.add(sst_tokens.encode_key(k), np.full(9000, rep + 1))
        w.close()
    with sst_tokens.open_shard(str(path)) as f:
        r = sst_tokens.Reader(f)
        assert len(r.index) > 5 and r.entries == 44
        assert [int(v[0]) for v in r.get(20)] == [1, 2, 3] and len(r.get(None)) == len(r.get(-7)) == 1 and r.get(99) == []


# 5

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_of(text):
    found = [[(k, m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in KINDS]
    joined = ",".join(f"{k}:{s}:{e}" for one in found for k, s, e in one)
    return (*map(len, found), hashlib.sha256(joined.encode()).hexdigest())


PII = ["a@b.c_d@e.f", "x@y", "x@y.z@w.v", "@a.b 1.2.3.4.5 0255.1.1.1 256.1.1.1", "+1 (2)3 4-5.6 7 8+123456789", "4111 1111 1111 1111 4111-1111", "é😀 4111111111111111 x\n+49 123 456 789", "1" * 5000, "a" * 5000 + "@", "+" + "1 " * 50, "a@b." * 300 + "c", "1.2.3.4" * 300, "+1" * 300, None, "", "٣.٣.٣.٣"]


def test_personal_data_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(PII)], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii_sanitise.report(df).collect()}
    assert got == {i: base_of(t) for i, t in enumerate(PII)}


def test_terms_that_give_entities_away(spark):
    rng = random.Random(4)
    rows = [(i, (f"{prose(rng, 6)} kontakt me{i}@x.org\n" if i % 4 == 0 else "") + prose(rng, 30), "en", "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in pii_sanitise.report(df).collect()}
    for i, t, *_ in rows:
        terms = [s.split(":") for s in got[i]["spans"].split(",") if s.startswith("term")]
        assert [t[int(a) : int(b)] for _, a, b in terms] == (["kontakt"] if i % 4 == 0 else [])
        assert tuple(got[i])[1:6] == base_of(t)
    clean = texts_of(pii_sanitise.sanitise(df))
    assert all("@" not in t and "kontakt" not in t for t in clean.values())
    assert clean[0].split("\n")[0].endswith("[email]") and clean[1] == rows[1][1]


def found_terms(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["spans"] for r in pii_sanitise.report(df).collect()}
    return {t[int(a) : int(b)] for i, t in enumerate(texts) for k, a, b in (s.split(":") for s in got[i].split(",") if s) if k == "term"}


def test_rare_terms_that_give_a_value_away(spark):
    rng = random.Random(14)
    # Half of all lines hold an address, so the kind says little; each name stands with one value only, in few lines.
    texts = [prose(rng, 8) + (f" u{i}@mail.example.com" if i % 2 else "") for i in range(600)]
    texts += [f"{prose(rng, 5)} Zorblax {prose(rng, 2)} zb@mail.example.com" for _ in range(19)]
    texts += [f"{prose(rng, 5)} Quimby +49 123 456 {n} 89" for n in ("7", "(7)", "-7")]
    assert found_terms(spark, texts) == {"Zorblax", "Quimby"}  # and not mail, example, com
    assert found_terms(spark, [*texts, *texts]) == {"Zorblax", "Quimby"}


def test_a_term_met_by_accident_stays(spark):
    rng = random.Random(15)
    texts = [prose(rng, 8) + (f" once{chr(97 + i % 26)}{chr(97 + i // 26)} u{i}@x.org" if i % 2 else "") for i in range(300)]
    assert found_terms(spark, texts) == set()
    assert found_terms(spark, ["éabc@x.org éabc@x.org zzz"] * 3 + [prose(rng, 8) for _ in range(300)]) == {"zzz"}


def test_personal_data_odd_rows(spark, odd):
    assert pii_sanitise.report(odd).count() == 7
    assert pii_sanitise.report(empty(spark)).count() == 0
    assert "Python" not in pii_sanitise.report(odd)._jdf.queryExecution().executedPlan().toString()


# 6


def without_repeats(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_substrings_against_brute_force(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in rlz_substring.remove(docs).collect()}
    assert got == without_repeats(texts_of(docs))


def test_substrings_in_periodic_and_overlapping_texts(spark):
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = [" ".join(base[a : a + n]) for a, n in ((0, 60), (30, 60), (10, 19), (10, 20), (0, 200), (100, 40))] + ["a b c " * 40, "b c a " * 40, "z " * 100]
    rows += [" ".join(["u", *base[50:75], "v", *base[60:90]])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    assert {r["doc_id"]: tuple(r)[1:] for r in rlz_substring.remove(df).collect()} == without_repeats(dict(enumerate(rows)))


def test_substrings_odd_rows(spark, odd):
    got = rlz_substring.remove(odd).collect()
    assert len(got) == 7 and sum(r["n_removed"] for r in got if r["n_words"] == 60) == 60 * 3 - 2  # of the first row, its first two words stay
    assert rlz_substring.remove(empty(spark)).count() == 0


# 7


def rules(text):
    text = text or ""
    w = text.encode().split()
    lines, dup = Counter(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += lines[line] > 0
            lines[line] += 1
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


MODEL = queries.vocabulary_file("piece_bpe_32k.model")


def test_quality_against_brute_force(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:7] for r in fertility_quality.measure(docs, MODEL).collect()}
    assert got == {i: rules(t) for i, t in texts_of(docs).items()}
    more = ["a\n\nb\na\n a\n", "x\n", "\n", "#a |b\r\n#a |b\r\n", "a b c a b c", "é é é é"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(more)], SCHEMA)
    assert {r["doc_id"]: tuple(r)[1:7] for r in fertility_quality.measure(df, MODEL).collect()} == {i: rules(t) for i, t in enumerate(more)}


def test_fertility_against_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = texts_of(docs)
    for r in fertility_quality.measure(docs, MODEL).collect():
        pieces = [p for w in words(texts[r["doc_id"]]) for p in library.encode(w.decode())]
        share = np.array(list(Counter(pieces).values())) / max(1, len(pieces))
        assert r["n_tokens"] == len(pieces)
        assert np.isclose(r["token_entropy"], -(share * np.log2(share)).sum())
        assert np.isclose(r["byte_share"], np.mean([library.is_byte(p) for p in pieces]) if pieces else 0)


def test_quality_rejects_noise_and_keeps_prose(spark, odd):
    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("⼀⼒⼳") for _ in range(6)) for _ in range(80))
    df = spark.createDataFrame([(0, prose(rng, 200), "en", "s", 0), (1, noise, "en", "s", 0), (2, " ".join("y" * 30 + str(k) for k in range(60)), "en", "s", 0)], SCHEMA)
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in fertility_quality.measure(df, MODEL).collect()}
    assert kept[0] == (False, True) and kept[1] == (False, False)
    good = fertility_quality.keep_good(odd, MODEL)
    assert good.columns == odd.columns and {r["doc_id"] for r in good.collect()} == {3}
    assert fertility_quality.measure(empty(spark), MODEL).count() == fertility_quality.keep_good(empty(spark), MODEL).count() == 0


def test_quality_rejects_random_characters_and_keeps_languages(spark):
    rng = random.Random(16)

    def soup(chars, n, low=3, high=9):
        return " ".join("".join(rng.choice(chars) for _ in range(rng.randint(low, high))) for _ in range(n))

    small = "abcdefghijklmnopqrstuvwxyz"
    bad = []
    for n in (80, 300):
        bad += [soup(small, n), soup(small + small.upper(), n), soup("bcdfghjklmnpqrstvwxz", n), soup(small + small.upper() + "0123456789+/", n, 76, 76)]
        bad += [soup("".join(map(chr, range(33, 127))), n), soup("!@#$%^&*()_+-=[]{};:,.<>/?|~", n, 1, 8), soup("абвгдежзийклмнопрстуфхцчшщъыьэюя", n), " ".join(f"{rng.random() * 1000:.4f}" for _ in range(n))]
    en = "The quick survey of the northern coast was finished in late autumn, when the ships had already returned to the harbour and the crews were waiting for their wages. Nobody expected that the report would be read by the minister himself, much less that he would ask for a second expedition before the winter."
    vi = "Cuộc khảo sát nhanh bờ biển phía bắc đã hoàn thành vào cuối mùa thu, khi các con tàu đã trở về bến cảng và thủy thủ đoàn đang chờ tiền lương của họ. Không ai nghĩ rằng bộ trưởng sẽ tự mình đọc bản báo cáo đó và hỏi thêm về chuyến đi."
    ru = "Быстрое исследование северного побережья было закончено поздней осенью, когда корабли уже вернулись в гавань, а команды ждали своего жалованья. Никто не ожидал, что отчёт прочтёт сам министр, и тем более что он попросит о второй экспедиции до зимы. Тогда капитан сел за стол, взял перо и написал длинное письмо домой, где его давно ждали жена и дети."
    good = [en, vi, ru, *[prose(rng, n) for n in (60, 200, 1500)]]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(bad + good)], SCHEMA)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in fertility_quality.measure(df, MODEL).collect()}
    assert [got[i] for i in range(len(bad))] == [(False, False)] * len(bad)
    assert [got[i] for i in range(len(bad), len(got))] == [(False, True)] * len(good)


# 8


def test_targets():
    assert mvh_mixing.targets([60, 60, 60], [1, 2, 3]) == [30, 60, 90]
    got = mvh_mixing.targets([10, 100, 100, 0], [3, 1, 1, 2])
    assert got == [30, 90, 90, 0] and mvh_mixing.targets([], []) == []


def test_tree_adds_up():
    quotas = np.array([5, 0, 77, 1000])
    got = mvh_mixing.split(quotas, 7, 1)
    assert (got.sum(axis=0) == quotas).all() and (got >= 0).all() and np.ptp(got.sum(axis=1)) <= 3
    assert (got == mvh_mixing.split(quotas, 7, 1)).all() and (got != mvh_mixing.split(quotas, 7, 2)).any()


def test_mixing(spark, docs):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(1, 80)), "en", "abcde"[min(4, int(rng.expovariate(1)))], 0) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mvh_mixing.plan(df).drop("shards").toPandas()
    size = {i: len(words(t)) for i, t, *_ in rows}
    assert (got["size"] == got["doc_id"].map(size)).all() and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"] == 0).all()
    got["source"] = got["doc_id"].map({i: s for i, _, _, s, _ in rows})
    by = got.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), held=("source_size", "first"))
    assert (by["size"] == by["held"]).all() and np.isclose(by["target"].sum(), by["size"].sum())
    assert ((by["taken"] - by["target"]).abs() < 80).all()
    mixed = mvh_mixing.mix(df)
    assert mixed.columns == df.columns
    again = Counter(r["doc_id"] for r in mixed.collect())
    assert all(again[i] * size[i] == t for i, t in zip(got["doc_id"], got["taken"]))
    other = mvh_mixing.plan(df.repartition(7)).drop("shards").toPandas()
    assert (other.sort_values("doc_id")["taken"].to_numpy() == got.sort_values("doc_id")["taken"].to_numpy()).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_fills_up_beside_a_giant(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(5, 90)), "en", "abc"[i % 3], 0) for i in range(900)]
    rows += [(1000 + k, prose(rng, 9000), "en", s, 0) for k, s in enumerate("abc")]
    got = mvh_mixing.plan(spark.createDataFrame(rows, SCHEMA), weights=(1.0, 1.7, 1.5), seed=seed).drop("shards").toPandas()
    got["source"] = got["doc_id"].map({i: s for i, _, _, s, _ in rows})
    for _, g in got.groupby("source"):
        times = g["taken"] // g["size"]
        left = g[times == times.min()]["size"].min()
        assert 0 <= g["target"].iloc[0] - g["taken"].sum() < left + 1


def test_mixing_fills_up_by_cells(spark, monkeypatch):
    """As in a large source, whose cells are added up before any document is looked at."""
    monkeypatch.setattr(mvh_mixing, "BLOCKS", 6)
    monkeypatch.setattr(mvh_mixing, "CELLS", 3)
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.randint(0, 90)), "en", "abcd"[i % 4 if i % 4 else 0], 0) for i in range(800)]
    rows += [(1000 + k, prose(rng, 4000), "en", s, 0) for k, s in enumerate("abcd")] + [(5, "twice five", "en", "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for seed in (1, 2):
        made = mvh_mixing.Plan(df, weights=(1.0, 1.7, 1.5), seed=seed)
        assert made.cells.count()
        got = mvh_mixing.plan(df, weights=(1.0, 1.7, 1.5), seed=seed).toPandas()
        got["source"] = [dict((r[0], r[3]) for r in rows)[i] for i in got["doc_id"]]
        for _, g in got[got["size"] > 0].groupby("source"):
            times = g["taken"] // g["size"]
            left = g[times == times.min()]["size"].min()
            assert 0 <= g["target"].iloc[0] - g["taken"].sum() < left + 3
        mixed = Counter((r["doc_id"], r["text"]) for r in mvh_mixing.mix(df, weights=(1.0, 1.7, 1.5), seed=seed).collect())
        size = {(i, t): len(words(t)) for i, t, *_ in rows}
        assert sum(size[k] * n for k, n in mixed.items()) == got["taken"].sum()


def test_mixing_is_reported_from_what_is_written(spark, docs, odd, monkeypatch):
    for df in (docs, odd):
        want = sorted(map(repr, mvh_mixing.plan(df).drop("shards").collect()))
        assert sorted(map(repr, mvh_mixing.report(df).collect())) == want
    made = mvh_mixing.Plan(docs)
    written = mvh_mixing.mix(docs)
    lost = written.where("size(split(text, ' ')) > 1").first()["doc_id"]
    got = {r["doc_id"]: r["taken"] for r in mvh_mixing.counted(made, written.where(F.col("doc_id") != lost)).collect()}
    assert got[lost] == 0 and sum(got.values()) > 0
    # the query itself must see a row lost by the writing
    real = mvh_mixing._mixed
    monkeypatch.setattr(mvh_mixing, "_mixed", lambda d, m: real(d, m).where(F.col("doc_id") != lost))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert {r["doc_id"]: r["taken"] for r in queries.op8_mvh_mixing(spark, "").collect()}[lost] == 0


def test_mixing_odd_rows(spark, odd):
    got = mvh_mixing.plan(odd).collect()
    assert len(got) == 7 and len({r["taken"] for r in got if r["doc_id"] == 1}) == 1
    assert mvh_mixing.mix(odd).columns == odd.columns
    assert mvh_mixing.plan(empty(spark)).count() == mvh_mixing.mix(empty(spark)).count() == 0


# 9


def test_parse_against_brute_force():
    model = cross_parse_langid.Model({"a": "the cat sat on the mat and ate", "b": "der hund lag auf der matte"})
    text = "the hund and theta x1 zz über matte"
    folded = [ord(c.lower()) if c.isalpha() else 0 for c in text]
    folded = [c for k, c in enumerate(folded) if c or not k or folded[k - 1]]
    classes = model.classes(np.array(folded)).tolist()
    for k, name in enumerate("ab"):
        labelled = model.classes(cross_parse_langid._collapse(np.array([ord(c) if c != " " else 0 for c in {"a": "the cat sat on the mat and ate", "b": "der hund lag auf der matte"}[name]]))).tolist()
        joined = "".join(map(chr, labelled))
        at = n = 0
        while at < len(classes):
            long = 0
            while at + long < len(classes) and "".join(map(chr, classes[at : at + long + 1])) in joined:
                long += 1
            at += max(1, long)
            n += 1
        got = cross_parse_langid.phrases(model, np.array(classes, np.int32), np.array([0, len(classes)]))
        assert got[0, k] == n


def parsed(classes, labelled):
    """Phrases of a sequence of symbols, cut at every SEGMENT."""
    joined, n = "".join(map(chr, labelled)), 0
    for cut in range(0, len(classes), cross_parse_langid.SEGMENT):
        part = "".join(map(chr, classes[cut : cut + cross_parse_langid.SEGMENT]))
        at = 0
        while at < len(part):
            long = 0
            while at + long < len(part) and part[at : at + long + 1] in joined:
                long += 1
            at += max(1, long)
            n += 1
    return n


@pytest.mark.parametrize("letters", [26, 3000])
def test_long_parses_and_large_alphabets_against_brute_force(letters):
    rng = random.Random(letters)
    some = [chr((0x61 if letters == 26 else 0x4E00) + k) for k in range(letters)]
    stock = {k: [rng.choice(some) + "".join(rng.choice(some[:9]) for _ in range(4)) for _ in range(40)] for k in "ab"}
    texts = {k: " ".join(rng.choice(stock[k]) for _ in range(500)) for k in "ab"}
    model = cross_parse_langid.Model(texts)
    assert len(model.comb.to) < 4 * sum(map(len, texts.values())) + 4 * (letters + 2)
    fold = cross_parse_langid._folds()
    codes = lambda t: model.classes(cross_parse_langid._collapse(fold[[ord(c) for c in t]])).tolist()
    docs = [" ".join(rng.choice(stock[k] + some) for _ in range(n)) for k, n in (("a", 300), ("b", 90), ("a", 3))]
    held = [codes(t) for t in docs]
    offsets = np.append(0, np.cumsum([len(h) for h in held]))
    got = cross_parse_langid.phrases(model, np.array(sum(held, []), np.int32), offsets)
    assert len(held[0]) > 2 * cross_parse_langid.SEGMENT
    assert got.tolist() == [[parsed(h, codes(texts[k])) for k in "ab"] for h in held]
    names, _ = cross_parse_langid.identify(model, pa.array(docs))
    bits = [[parsed(h, codes(texts[k])) * np.log2(len(codes(texts[k]))) for k in "ab"] for h in held]
    assert names == ["ab"[int(np.argmin(b))] for b in bits]


def test_labelled_text_is_dealt_in_equal_shares(spark):
    assert cross_parse_langid.shares([5, 100, 3], 48) == [5, 40, 3] and cross_parse_langid.shares([4, 4], 100) == [4, 4] and cross_parse_langid.shares([], 5) == []
    long = "b" * 100_000 + "c" * 100_000
    df = spark.createDataFrame([(0, long, "xa", "s", 0), *[(k, "aa" * 40, "xa", "s", 0) for k in range(1, 6)]], SCHEMA)
    model = cross_parse_langid.learn(df, F.lit(False), symbols=1000)
    assert set(map(chr, model.letters)) == {"a", "b", "c"} and 900 < 2 ** model.bits[0] < 1100
    assert cross_parse_langid.learn(df, F.lit(False), rows=2, symbols=50).bits[0] < 6


def test_languages_on_held_out_rows(spark):
    rng = random.Random(13)
    parts = {"xa": ["tho", "ing", "wer", "sha", "ea"], "xb": ["ion", "que", "elle", "é", "aux"], "xc": ["ung", "sch", "ö", "ber", "kei"]}
    rows = [(i, " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 300))), name, "s", 0) for i in range(300) for name, p in [list(parts.items())[i % 3]]]
    rows += [(1000, None, "xa", "s", 0), (1001, "", "xa", "s", 0), (1002, "12 34 !!", "xa", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    got = {r["doc_id"]: r for r in cross_parse_langid.predict(df, held).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002))
    out = [got[i]["lang_pred"] == name for i, _, name, *_ in rows[:300] if got[i]["held_out"]]
    assert len(out) > 40 and np.mean(out) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_odd_rows(spark, odd):
    got = cross_parse_langid.predict(odd, F.lit(False)).collect()
    assert len(got) == 7 and sum(r["lang_pred"] == "und" for r in got) == 2
    assert {r["lang_pred"] for r in cross_parse_langid.predict(odd, F.lit(True)).collect()} == {"und"}
    assert cross_parse_langid.predict(empty(spark), F.lit(False)).count() == 0


# 10


def test_served_is_monotone_and_near_its_share():
    for totals in ([5000, 3, 1, 70000, 1234], [7], [1] * 30, [10**6, 1]):
        t = np.array(totals)
        every = t.sum()
        w = np.arange(-(-every // 64) + 1)
        a = drr_packing.Rounds(t, size=64).served(w)
        assert (np.diff(a, axis=0) >= 0).all() and (a.sum(axis=1) == np.minimum(64 * w, every)).all() and (a[-1] == t).all()
        assert np.abs(a - np.minimum(64 * w, every)[:, None] * t / every).max() < 2 + len(totals) / 8


def naive_rounds(totals, rates, size):
    """Deficit round-robin token by token: the source whose next token is due first is served."""
    next_, out = [0] * len(totals), [[] for _ in totals]
    for rank in range(sum(totals)):
        s = min((s for s in range(len(totals)) if next_[s] < totals[s]), key=lambda s: ((next_[s] + 0.5) / rates[s], s))
        out[s].append(rank // size)
        next_[s] += 1
    return out


@pytest.mark.parametrize("totals,rates", [([500, 30, 7], None), ([300, 300, 300], [3.0, 2.0, 1.0]), ([1000, 1, 1, 60], None), ([40, 900], [5.0, 0.01]), ([333], None), ([128, 128], [1.0, 1.0])])
def test_rounds_against_token_by_token(totals, rates):
    size = 64
    rounds = drr_packing.Rounds(np.array(totals), rates, size)
    want = naive_rounds(totals, [float(t) for t in totals] if rates is None else rates, size)
    rng = random.Random(7)
    full, seen = sum(totals) // size, Counter()
    for s, total in enumerate(totals):
        cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(9))})
        start, n = np.array(cuts[:-1]), np.diff(cuts)
        got = [None] * total
        for some in (slice(None, 4), slice(4, None)):
            if not len(start[some]):
                continue
            for d, at, m, q, o in zip(*(x.tolist() for x in rounds.pieces(s, start[some], n[some]))):
                for k in range(m):
                    i = int(start[some][d]) + at + k
                    assert got[i] is None
                    got[i] = q
                    seen[q, o + k] += 1
        assert [min(q, full) for q in got] == want[s]
    assert set(seen.values()) == {1}
    lengths = Counter(q for q, _ in seen)
    assert all(max(o for r, o in seen if r == q) + 1 == n and (n == size or n & (n - 1) == 0) for q, n in lengths.items())


def test_rounds_do_not_grow_with_the_corpus():
    import tracemalloc

    start, n = np.array([0, 400, 900]) + 10**6, np.array([400, 500, 300])
    tracemalloc.start()
    for totals in ([10**13, 10**7, 10**12], [10**7, 10**13], [10**13] * 40):
        rounds = drr_packing.Rounds(np.array(totals))
        for s in range(len(totals)):
            doc, at, length, _, offset = rounds.pieces(s, start, n)
            assert np.bincount(doc, weights=length).tolist() == n.tolist() and (offset + length <= 2048).all()
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_runs_never_span_a_gap():
    whose, start, n = np.array([1, 0, 1, 1, 0]), np.array([10, 0, 0, 99, 5]), np.array([5, 5, 10, 1, 2])
    assert [r.tolist() for r in drr_packing.runs(whose, start, n)] == [[1, 4], [2, 0], [3]]


def test_packing_to_targets(spark):
    rng = random.Random(33)
    rows = [(f"k{i}", prose(rng, 300), "en", "abc"[i % 3], 0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string")).repartition(4)
    got = drr_packing.pack(df, queries.word_bpe(), targets={"a": 3.0, "b": 1.0}).toPandas()
    per = got.groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    total = got.groupby("source")["length"].sum()
    first = per.iloc[: int(total["a"] / (0.75 * (total["a"] + total["b"]) / total.sum() * 2048)) - 1]
    want = 2048 * (total["a"] + total["b"]) / total.sum()
    assert len(first) > 5 and ((first["a"] - 0.75 * want).abs() < 3).all() and ((first["b"] - 0.25 * want).abs() < 3).all()
    assert set(got["doc_id"]) == {r[0] for r in rows}
    with pytest.raises(ValueError):
        drr_packing.pack(df, queries.word_bpe(), targets={"a": 0.0})


def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    vocabulary = queries.word_bpe()
    library = Tokenizer.from_file(vocabulary.path)
    got = drr_packing.pack(docs, vocabulary).toPandas()
    texts, whole = texts_of(docs), {}
    for i, t in texts.items():
        whole[i] = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g["start"].to_numpy() == np.cumsum(np.append(0, g["length"]))[:-1]).all() and g["length"].sum() == len(whole[i]) == g["doc_tokens"].iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(whole[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(got["doc_id"]) == set(texts)
    total, padded = 0, 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.cumsum(np.append(0, g["length"]))[:-1]).all()
        n = int(g["length"].sum())
        assert n <= 2048
        total += n
        padded += 0 if n & (n - 1) == 0 else 2048 - n
    assert total == sum(map(len, whole.values())) and padded == 0
    full = got[got["sequence_id"] < total // 2048]
    share = got.fillna({"source": "-"}).groupby("source")["length"].sum() / total
    per = full.fillna({"source": "-"}).groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    assert ((per - 2048 * share).abs() <= 3).all().all()
    rows = drr_packing.pack(odd, vocabulary).toPandas()
    assert rows.groupby(["sequence_id"])["length"].sum().sum() == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in [r["text"] for r in odd.collect()])
    assert drr_packing.pack(empty(spark), vocabulary).count() == 0


# all


def test_words_of_blocks():
    texts = ["a  b", "", " x\ty\n", "é", None, "\x0b\x0c", "q"]
    block = TextBlock(pa.array(texts))
    assert block.n_words.tolist() == [len(words(t)) for t in texts]
    got = [block.data[s:e].tobytes() for s, e in zip(block.starts, block.ends)]
    assert got == [w for t in texts for w in words(t)]
    sliced = TextBlock(pa.array(["zz", *texts, "yy"]).slice(1, len(texts)))
    assert (sliced.word_hashes() == block.word_hashes()).all()


def thue_morse(n, a, b, sep=""):
    return sep.join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


TWINS = [thue_morse(n, x, y) for n in (1024, 2048, 4096) for x, y in ("ab", "ba")]


def test_words_whose_polynomial_hashes_agree_are_told_apart():
    block = TextBlock(pa.array([" ".join(TWINS)]))
    for seed in (0, 1):
        assert len(set(block.word_hashes(seed).tolist())) == len(TWINS)
    assert not set(block.word_hashes(0).tolist()) & set(block.word_hashes(1).tolist())
    rows = TextBlock(pa.array([thue_morse(2048, *p, sep=" ") for p in (("ka", "lo"), ("lo", "ka"))]))
    w = rows.word_hashes()
    assert len(set(summed(w, rows.first_word[:-1], rows.n_words).tolist())) == 2
    at, grams = rows.grams(w, 1024)
    assert len(set(grams.tolist())) == len({tuple(w[a : a + 1024].tolist()) for a in at})


@pytest.mark.parametrize("vocabulary", [queries.byte_bpe(), queries.word_bpe()])
def test_words_whose_polynomial_hashes_agree_get_their_own_ids(vocabulary):
    made = Encoder(vocabulary.path, vocabulary.end, vocabulary.spaces)
    texts = [*TWINS, " ".join(TWINS), *TWINS[::-1]]
    ids, at = made.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == made.library.encode(t, add_special_tokens=False).ids + [vocabulary.end]


def test_words_that_agree_in_one_hash_are_encoded_by_the_library(monkeypatch):
    real = TextBlock.word_hashes
    monkeypatch.setattr(TextBlock, "word_hashes", lambda self, seed=0: real(self, seed) if seed else real(self, 0) % np.uint64(50))
    for vocabulary in (queries.byte_bpe(), queries.word_bpe()):
        made = Encoder(vocabulary.path, vocabulary.end, vocabulary.spaces)
        texts = [t or "" for _, t, *_ in corpus()]
        for _ in range(2):
            ids, at = made.encode(pa.array(texts))
            for k, t in enumerate(texts):
                assert ids[at[k] : at[k + 1]].tolist() == made.library.encode(t, add_special_tokens=False).ids + [vocabulary.end]


def test_word_cache_is_of_fixed_size():
    cache, rng = WordCache(slots=8), np.random.default_rng(1)
    pieces = {int(k): rng.integers(0, 9, rng.integers(0, 9)) for k in rng.integers(1, 1 << 62, 300)}
    for _ in range(50):
        keys = rng.choice(list(pieces), 20, replace=False).astype(np.uint64)

        def learn(new):
            held = [pieces[int(k)] for k in keys[new]]
            return np.array([len(h) for h in held]), np.concatenate([*held, []]).astype(np.int64)

        begin, size, flat = cache.pieces(keys, mixed(keys), learn)
        assert [flat[b : b + n].tolist() for b, n in zip(begin, size)] == [pieces[int(k)].tolist() for k in keys]


def test_substrings_and_copies_of_words_whose_polynomial_hashes_agree(spark):
    rng = random.Random(31)
    base = prose(rng, 60).split()
    other = [TWINS[1] if w == base[30] else w for w in base]
    base = [TWINS[0] if w == base[30] else w for w in base]
    rows = [" ".join(base), " ".join(other), *[thue_morse(2048, *p, sep=" ") for p in (("ka", "lo"), ("lo", "ka"))]]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    assert {r["doc_id"]: tuple(r)[1:] for r in rlz_substring.remove(df).collect()} == without_repeats(dict(enumerate(rows)))
    assert all(r["copy_of"] == r["doc_id"] for r in omh_dedup.classes(df).collect())
    got = {r["doc_id"]: tuple(r)[1:7] for r in fertility_quality.measure(df, MODEL).collect()}
    assert got == {i: rules(t) for i, t in enumerate(rows)}


def test_pipeline_keeps_columns_and_is_whole(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(70, 200)), "en", f"s{i % 4}", 0) for i in range(80)]
    rows += [(100, rows[3][1], "en", "s1", 0), (101, rows[4][1].replace(" ", "  "), "en", "s2", 0), (102, " ".join(["new", *rows[5][1].split()[1:]]), "en", "s3", 0), (103, "too short", "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    assert kept["quality"] == [*range(80), 100, 101, 102]
    assert kept["exact_dedup"] == [*range(80), 102]
    assert kept["near_dedup"] == list(range(80))
    assert set(kept["mixing"]) <= set(kept["near_dedup"])
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(51)
    long = spark.createDataFrame([(7, prose(rng, 60_000), "en", None, 0), (None, prose(rng, 80), None, "b", 0), (9, prose(rng, 70), "en", "c", 0)] + [(11, "same text of all " + prose(random.Random(52), 60), "en", "c", 0)] * 3, SCHEMA)
    for name in odd.columns[5:]:
        long = long.withColumn(name, F.lit("x"))
    docs = odd.unionByName(long)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == odd.columns
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
        none = stage(spark, empty(spark), "")
        assert none.columns == empty(spark).columns and none.count() == 0
    assert kept["quality"] == {3: 1, 7: 1, None: 1, 9: 1, 11: 3}
    assert kept["exact_dedup"] == kept["near_dedup"] == {3: 1, 7: 1, None: 1, 9: 1, 11: 1}
    packed = pipeline.packing(spark, odd.unionByName(long), "").toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all() and packed["length"].sum() > 60_000
    assert len(packed[packed["doc_id"].isna()]) >= 3 and pipeline.packing(spark, empty(spark), "").count() == 0


def test_pipeline_stages_begin_and_write_with_heaps_collected(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    docs = spark.createDataFrame(corpus(n=10), SCHEMA).where("text is not null")
    for name, stage in pipeline.STAGES:
        before = full()
        stage(spark, docs, "")
        assert full() >= before + 2, name


def test_hadoop_names_of_stores():
    where, at = sst_tokens.place("file:///tmp/x.sst")
    assert at == "/tmp/x.sst"
    with pytest.raises(Exception, match="(?i)unrecognized|scheme|filesystem"):
        sst_tokens.place("nostore://x/y")
