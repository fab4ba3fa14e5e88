"""Edge cases of the operators and of the pipeline's stages: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import shutil
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from quadloom.llm import bpe, common, decontam, langid, pii, simhash, toxicity
from tests.llm.test_decontam_brute import plain_longest, plain_words
from tests.llm.test_near_copies import kept
from tests.llm.test_operators import plain_components, plain_fingerprint
from tests.llm.test_toxicity_more import plain_score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, near_row long, toxic_score double, leaks string, fp long, TEXTS string"


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, 0.5, "x", 9, "y") for i, t in rows], SCHEMA)


LONG = "river stone " * 150_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!!!"), (5, LONG), (6, "one"), (6, "one"), (None, "one"), (None, None), (8, "sea sand sun shore wave"), (7, "sea sand sun shore wave")]


def test_simhash_rows_without_ids_link_others(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [*ODD, (50, base), (None, base + " tail"), (40, base + " tail tail2")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(dict(enumerate(prints)))
    smallest = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            smallest[label[n]] = min(i, smallest.get(label[n], i))
    want = [(i, f"{prints[n]:016x}", smallest.get(label[n])) for n, (i, _) in enumerate(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_bpe_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    of = sorted((i or 0, len(known.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    got = bpe.encode(frame(spark, ODD), path, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in got) == of
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_pii_edges(spark):
    df = frame(spark, [*ODD, (20, "mail a.b@example.org " * 20_000)]).withColumn("n_private", F.lit("clash")).withColumn("kinds", F.lit(1))
    got = pii.pseudonymise(df, "k").collect()
    assert len(got) == len(ODD) + 1 and all(r.n_private == (20_000 if r.doc_id == 20 else 0) for r in got if r.text)
    assert sorted(r.text or "" for r in got if r.doc_id != 20) == sorted(t or "" for _, t in ODD)
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0


# language: a plain version of the prediction, and what the dictionaries hold
def plain_predict(model, text):
    clean = langid.normalised(text)
    if not any(c.isalpha() for c in clean) or not model.dictionaries:
        return "und", 0.0, True
    data, sizes = f" {clean} ".encode(), {}
    for lang, told in model.dictionaries.items():
        c = zstandard.ZstdCompressor(level=model.settings.level, dict_data=zstandard.ZstdCompressionDict(told, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(c.compress(data[at : at + model.settings.chunk])) for at in range(0, len(data), model.settings.chunk))
    first, *others = sorted((n, lang) for lang, n in sizes.items())
    second = others[0][0] if others else 2 * first[0]
    return first[1], 1 / sum(math.exp(-min(50, (n - first[0]) / 4)) for n in sizes.values()), second < 1.01 * first[0]


def test_language_against_a_plain_version(spark):
    rng = random.Random(5)
    vocabulary = {"aa": "kuma tilo sare wopi nalu", "bb": "xento brifa glost dremp plick", "cc": "órale niño años señor mañana"}
    rows = [(i, " ".join(rng.choice(v.split()) for _ in range(rng.randrange(1, 60))) + f" mark{chr(97 + i % 26)}{chr(97 + i // 26)}", lang) for i, (lang, v) in enumerate(list(vocabulary.items()) * 40)]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123", "cc"), (203, "kuma " * 60_000, "aa"), (None, "kuma xento", "aa"), (204, "tilo brifa", None), (1, rows[1][1], rows[1][2]), (205, "...", "dd")]
    df = spark.createDataFrame([(i, t, la, 0.5, "x", "y") for i, t, la in rows], "doc_id long, text string, lang string, score double, lang_pred string, held_out string")
    model = langid.fit(df)
    assert sorted(model.dictionaries) == ["aa", "bb", "cc"]
    for i, t, la in rows[:120]:
        mark = t.split()[-1].encode()
        assert (mark in b"".join(model.dictionaries.values())) == (fold(i, 5) != 0) and (fold(i, 5) == 0 or mark in model.dictionaries[la])
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.rejected) for r in langid.predict(df, model).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        lang, score, rejected = plain_predict(model, t)
        want.append((i, fold(i, 5) == 0, lang, round(score, 9), rejected))
    assert got == sorted(want, key=repr)
    held = [(g[2], rows[g[0]][2]) for g in got if g[1] and g[0] is not None and g[0] < 120]
    assert len(held) > 10 and all(a == b for a, b in held)
    assert any(g[4] for g in got) and langid.predict(df.where("false"), model).count() == 0
    nothing = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_ties_go_to_the_smaller_language():
    model = langid.Model({"zz": b"same words here", "mm": b"same words here"}, langid.Settings())
    assert model.predict("same words", model.compressors()) == ("mm", pytest.approx(0.5), True)


# the pipeline
@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra se ti vo zu".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, " ".join(rng.choice(words) for _ in range(20)).capitalize() + ".") for i in range(10)]
    rows = [(i, text(rng.randrange(20, 80))) for i in range(240)]
    rows += [(300 + i, rows[i][1] + (" rotten scum" if i % 2 else " vile clown")) for i in range(60)]
    for i in range(12):  # near copies and copies
        base = rows[100 + i][1].split()
        rows += [(400 + 2 * i, " ".join(base)), (401 + 2 * i, " ".join([*base[:-1], "changed"]))]
    rows += [(500 + i, f"{text(15)}\n{items[i][1]}\n{text(15)}") for i in range(10)]
    rows += [(600, f"{text(30)} mail jane.doe@example.org now"), (601, f"{text(30)} card 4111 1111 1111 1111")]
    rows += [(1000 + i if i is not None else None, t) for i, t in ODD]
    labels = [(i, int(300 <= i < 360)) for i, _ in rows if i is not None and i < 400]
    return rows, labels, items


def test_stages_one_by_one_and_run(spark, corpus, tmp_path):
    rows, labels, items = corpus
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    by_id = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    clean = [(i, t) for i, t in rows if plain_score(model, t) < 0.3]
    now = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert now.columns == docs.columns and by_id(now) == sorted(clean, key=repr)
    assert not {i for i, _ in clean} & set(range(300, 360)) and {i for i, _ in rows if i is not None and i < 240} <= {i for i, _ in clean}
    now = corpus_pipeline.drop_near_copies(spark, now, str(tmp_path))
    named = [(i, t) for i, t in clean if i is not None]
    single = kept(sorted(named))
    got = by_id(now)
    assert now.columns == docs.columns and sorted(i for i, _ in got) == sorted(single)
    now = corpus_pipeline.drop_leaks(spark, now, str(tmp_path))
    own = [plain_words(t) for _, t in items]
    whole = [(i, t) for i, t in got if not any(plain_longest(plain_words(t), item) for item in own)]
    assert now.columns == docs.columns and by_id(now) == whole and not {i for i, _ in whole} & set(range(500, 510)) and 600 in dict(whole)
    now = corpus_pipeline.pseudonyms(spark, now, str(tmp_path))
    told = {r.doc_id: r for r in now.collect()}
    changed = {i for i, t in whole if told[i].text != t}
    assert now.columns == docs.columns and changed == {600, 601} and all(r.n_chars == (None if r.text is None else len(r.text)) for r in told.values())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((i, hashlib.sha256(np.array(known.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()) for i, r in told.items())
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in last.collect()) == want
    folder = common.mounted(common.shared_folder(spark)) + "/quadloom"
    import os

    assert sum(x.startswith("pipeline-") for x in os.listdir(folder)) == 1
    shutil.rmtree(folder)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, corpus, tmp_path, stage):
    rows, labels, items = corpus
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())


def test_decontam_of_no_documents(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontam.decontaminate(frame(spark, []), bench).count() == 0
