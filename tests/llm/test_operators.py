"""The operators against plain versions, on small tables with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quadloom.llm import bpe, decontam, langid, licenses, ngram, pii, sharding, simhash, topk, toxicity
from quadloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, shard int"


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "Zeta,", "eta."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", "  \n\t", "one", "two words", "!!! ...", "é漢字 \U0001f600 mixed Case", "x" * 5000]
    out += [words(rng, n) for n in (3, 4, 10, 50, 200, 3000)]
    base = words(rng, 300)
    out += [base, base, base + " tail", base.replace("alpha", "alphas", 1)]
    out += [words(rng, 40) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "fp", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash
def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(prints)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_simhash_matches_spark_hash(spark):
    text = "Alpha beta"
    assert spark.sql(f"select xxhash64('{text.lower()}')").first()[0] % 2**64 == xxhash.xxh64_intdigest(text.lower().encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 7, dtype=np.uint64)
    values = base[rng.integers(0, 7, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    want = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    assert (simhash.close_matrix(values, radius) == want).all()
    assert (simhash.close_pairs(values[:-1], values[1:], radius) == np.diagonal(want, 1)).all()


def test_links_of_large_keys_are_refined(spark, monkeypatch):
    """Many fingerprints in a small ball: every key is over the bucket and all three levels run."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = sorted({center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)})
    rows = [(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(rows, "id long, fp long"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = plain_components(dict(enumerate(prints)))
    assert {i: got.get(i, i) for i in want} == want


def test_one_of_each_keeps_columns(docs, texts):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = plain_components({i: plain_fingerprint(t) for i, t in enumerate(texts)})
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(want.values())


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 400)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(200, 400)) and 5 not in got


# toxicity
@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        group = rng.choice(["women", "muslims", "men", "nobody"])
        text = words(rng, 30) + f" {group} " + (rng.choice(["idiot scum", "stupid", "you clown"]) if toxic else rng.choice(["apple", "river", ""]))
        docs.append((i, text, "en", "s", 1, 0.0, "", 0))
        labels.append((i, None if i % 50 == 1 else int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1), (9999, 0)], "doc_id long, toxic int")


def test_toxicity_separates_and_ignores_identity(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out)
    assert abs(model.score("a muslim came") - model.score("a christian came")) < 0.02
    assert model.score(None) == model.score("") < 0.3 < model.score("IDIOT!!")


def test_counterfactual_penalty_shrinks_identity_weight():
    rows = [np.array([0, 1]) if i % 2 else np.array([2]) for i in range(200)]
    labels = np.array([i % 2 for i in range(200)], float)
    swaps = [(np.array([1]), np.array([3]))] * 20
    free, _ = toxicity.fit_logistic(rows, labels, [], 4, toxicity.Settings())
    held, _ = toxicity.fit_logistic(rows, labels, swaps, 4, toxicity.Settings())
    assert abs(held[1] - held[3]) < 0.2 * abs(free[1]) and held[0] > 1


def test_toxicity_without_labels(docs, texts, spark):
    got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert len(got) == len(texts) + 1 and all(r.predicted == 0 for r in got)


# PII: a plain mirror of the networks
def mirror(s, key, kind, hexadecimal=False):
    half = len(s) // 2
    left, right = s[:half], s[half:]

    def shift(part, stream):
        out = ""
        for i, c in enumerate(part):
            k = int(stream[i % 32 * 2 : i % 32 * 2 + 2], 16)
            base, n = (48, 10) if c.isdigit() else (97, 6 if hexadecimal else 26) if c.islower() else (65, 6 if hexadecimal else 26) if c.isupper() else (0, 0)
            out += chr((ord(c) - base + k) % n + base) if n else c
        return out

    digest = lambda i, other: hashlib.sha256("|".join([key, kind, str(i), str(len(s)), other.lower()]).encode()).hexdigest()
    for i in range(8):
        if i % 2 == 0:
            left = shift(left, digest(i, right))
        else:
            right = shift(right, digest(i, left))
    return left + right


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pii(spark):
    texts = {
        1: "mail jane.doe7@example.org and 4111 1111 1111 1111, again 4111111111111111.",
        2: "not a card 4111111111111112; ip 10.0.0.300 stays, 10.1.2.3 goes",
        3: "born 1999-02-29 (no date) or 2000-02-29, 24.12.1990, 13/31/2000, 12/31/2000",
        4: "call +1 (017) 555-7713 or +49 30 1234567",
        5: "ssn 123-45-6789 and 000-45-6789",
        6: "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE00 3704 0044 0532 0130 00",
        7: 'TOKEN = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"',
        8: None,
        9: "",
        10: "ordinary text, 12 apples, 3.5 pears",
        11: "4111111111111111" * 3,
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in [*texts.items(), (1, texts[1])]], "doc_id long, text string, kinds string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert got[8].text is None and got[9].text == "" and got[10].text == texts[10] and got[11].text == texts[11]
    first = got[1].text.split()
    assert first[1] == mirror("jane.doe7", "k", "email") + "@example.org"
    body = mirror("411111111111111", "k", "card")
    card = body + next(str(d) for d in range(10) if luhn(body + str(d)))
    assert got[1].text.endswith(f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}, again {card}.")
    assert "4111111111111112" in got[2].text and "10.0.0.300" in got[2].text and "10.1.2.3" not in got[2].text and got[2].kinds == "ipv4"
    assert "1999-02-29" in got[3].text and "2000-02-29" not in got[3].text and "24.12.1990" not in got[3].text and "13/31/2000" in got[3].text and got[3].n_private == 3
    assert got[4].text.startswith("call +1 (") and "017" not in got[4].text and "+49 " in got[4].text and got[4].n_private == 2
    assert "123-45-6789" not in got[5].text and "000-45-6789" in got[5].text
    ibans = got[6].text.removeprefix("iban ").split(" and ")
    number = lambda s: int("".join(str(int(c, 36)) for c in s.replace(" ", "")[4:] + s[:4]))
    assert number(ibans[0]) % 97 == 1 == number(ibans[1]) % 97 and ibans[2].startswith("DE00 3704") and ibans[0][4] == " "
    assert got[7].text == f'TOKEN = "{mirror("9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "k", "secret", True)}"'


def test_pii_permutes(spark):
    """No two dates or area codes share a pseudonym, and all stay valid."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = [r.text for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == 3000 and all(1900 <= int(t[:4]) <= 2099 for t in got)
    df = spark.range(1, 900).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-12-3456")).alias("text"))
    got = [r.text for r in pii.pseudonymise(df, "k").where("n_private > 0").collect()]
    assert len(got) == len(set(got)) == 898 and not any(t.startswith(("000", "666", "9")) for t in got)


# sharding
def test_sharding(docs, texts):
    got = sharding.shard(docs).collect()
    assert len(got) == len(texts) + 1
    slots, groups = {}, {}
    for r in got:
        t = texts[r.doc_id]
        data = (t or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(t, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_balances_and_splits_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else words(rng, rng.randrange(5, 60))) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, texts = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        texts.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    assert all(len(s) == 1 for t, s in texts.items() if not t.startswith("hot text hot"))
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# BPE
def test_bpe(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = known.encode_ordinary(texts[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_random_pieces():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.Tokenizer(ranks, public_tokenizers.PATTERN, remembered=50)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for text in ["a" * 20000, "ab" * 999, *["".join(rng.choice("abetn é漢\U0001f600\n1'") for _ in range(rng.randrange(1, 80))) for _ in range(400)]]:
        ids = own.encode(text)
        assert ids == known.encode_ordinary(text) and own.decode(ids).decode() == text


# language
def test_langid(spark, docs, texts):
    rng = random.Random(1)
    vocabulary = {"aa": "kuma tilo sare wopi nalu", "bb": "xento brifa glost dremp plick", "cc": "órale niño años señor mañana"}
    rows = [(i, " ".join(rng.choice(v.split()) for _ in range(40)), lang) for i, (lang, v) in enumerate(list(vocabulary.items()) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "aa"), (902, "kuma tilo", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].held_out == (fold(i, 5) == 0) for i, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(langid.predict(docs, langid.fit(docs)).collect()) == len(texts) + 1


# language model
def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5, 5, 5], np.cumsum(rng.integers(0, 9, 5000)), np.cumsum(rng.integers(0, 10**6, 3000))):
        values = np.array(values, np.int64)
        code = ngram.EliasFano.encode(values)
        assert (code[np.arange(len(values))] == values).all() if len(values) else True


def test_ngram_empty(empty):
    assert ngram.fit_and_score(empty).count() == 0


# top-k
def test_topk(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 9).astype(np.float32)]) for i in range(120)]
    rows += [(i, rows[50][1]) for i in range(200, 260)]
    odd = [(300, None), (301, [None] + [0.1] * 8), (302, [float("nan")] * 9), (303, [float("inf")] + [0.0] * 8), (304, [0.5, 0.5]), (350, [0.25, 1.0]), (400, [])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    valid = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in [*rows, (304, [0.5, 0.5]), (350, [0.25, 1.0]), (400, [])]}
    for q in (0, 50, 100, 200, 250, 350):
        scored = sorted((-sum(a * b for a, b in zip(valid[q], v, strict=True)), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert 300 not in got and 400 not in got
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


# licences
def test_licenses(spark):
    texts = {
        1: "some prose\nReleased under the MIT License.",
        2: "This work is licensed under the GNU General Public Licence, version 3.\nmore",
        3: "Copyright (c) 2020 Someone\n\n" + licenses.MIT.upper(),
        4: "The MIT License\n\nCopyright 2001 X\n\n" + licenses.MIT.replace("\n\n", "\n\n\n"),
        5: "prose that mentions the MIT License in passing",
        6: None,
        7: "",
        8: "intro\n\n" + licenses.TEXTS["ISC"].split("\n\n")[0].replace(", ", ",\n") + "\n\nLicensed under CC BY-NC 4.0.",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in [*texts.items(), (1, texts[1])]], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert sorted(got) == sorted(texts)
    assert [got[i].licenses for i in (1, 2, 5, 6, 7)] == ["MIT", "GPL-3.0", "", "", ""]
    assert got[3].licenses == "MIT" and got[3].whole
    assert got[8].licenses == "CC-BY-NC-4.0"


def test_license_forms_agree(spark):
    """The column form and the plain form are the same function."""
    samples = ["Licence  v2.0 — (C) me\n© You\nAll rights reserved.\nsub-licensed", "GPL V3.0, version 2.10", "http://x.org COPYRIGHT HOLDERS", "snake_case_words\tand tabs", *licenses.TEXTS.values()]
    df = spark.createDataFrame([(s,) for s in samples], "text string").select("text", licenses.canonical_column(F.col("text")).alias("c"))
    for r in df.collect():
        assert " ".join(r.c.split()) == licenses.canonical(r.text)


# decontamination
@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "A farmer named Alice has 12 apples and gives 5 apples to her friend Bob before walking 3 km home."), (2, "What is the capital city of the northern province?"), (3, "tiny"), (4, None), (5, "")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, benchmark):
    texts = {
        1: "intro words. A farmer named Alice has 12 apples and gives 5 apples to her friend Bob before walking 3 km home. outro",
        2: "A farmer named Carol has 90 apples and gives 7 apples to her friend Dave before walking 8 km home.",
        3: "A FARMER!! NAMED!! something else entirely has happened to the apples",
        4: "they asked: what is the capital city of the northern province?",
        5: "what is the capital city of the southern province",
        6: None,
        7: "",
        8: "tiny",
        9: "one " * 40,
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in [*texts.items(), (1, texts[1])]], "doc_id long, text string, item_id int")
    got = {r.doc_id: r for r in decontam.decontaminate(df, benchmark).collect()}
    assert {i: list(got[i].item_ids) for i in got} == {1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: [], 7: [], 8: [], 9: []}
    assert got[1].longest >= 19 and got[1].contaminated and not got[6].contaminated
    assert decontam.decontaminate(df, benchmark.where("false")).where("contaminated").count() == 0
    small = decontam.Settings(block=1)
    assert {r.doc_id for r in decontam.decontaminate(df, benchmark, small).where("contaminated").collect()} == {1, 2, 4}


def test_slots_must_map_one_to_one(spark):
    item = "Sum the value 7 and the value 7 with the value 9 then print it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("7", "4")), (2, item.replace("7", "4", 1))]
    got = {r.doc_id: r.contaminated for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False}
