"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ionweave.llm import audio, exact, langid, lines, mixing, packing, pii, quality, simhash, substring
from ionweave.llm.common import Scratch, in_fold
from ionweave.operators.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators use or return: none may disturb them.
EXTRA = ["kept", "name", "row", "level", "chunk", "size", "key", "fp", "term", "score", "keys", "bucket"]


def fixture():
    """(doc_id, text, lang, source)"""
    rng = random.Random(7)
    make = {"en": ["the", "of", "and", "ing", "tion", "wh", "st"], "de": ["sch", "ung", "ein", "der", "keit", "ä"], "fr": ["eau", "oi", "é", "ment", "que"]}
    word = lambda lang: "".join(rng.choice(make[lang]) for _ in range(rng.randint(1, 4)))
    prose = lambda lang, n: " ".join(word(lang) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))
    passage = prose("en", 60)
    shared = "A line that stands in many documents, word for word"
    rows = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        text = prose(lang, rng.randint(1, 150))
        if i % 5 == 0:
            text += f" {passage} " + prose(lang, 20)
        if i % 4 == 0:
            text += f"\n  {shared.upper() if i % 8 else shared}\t\nshort\n"
        if i % 6 == 0:
            text += " mail a.b%c@x-y.example.org_z@q.de, 1.2.3.4.5.6.7.8 and 256.1.1.1, 4111 1111-1111 1111 or 4111111111111112, +49 (30) 1234-5678. +1 2"
        rows.append([i * 7 % 61, text, lang if i % 10 else None, f"src{i % 4}" if i % 9 else None])
    base = rows[3][1]
    for k in range(4):
        rows.append([100 + k, base, "en", "src0"])  # exact copies
    near = prose("en", 400).split(" ")
    for k in range(6):
        copy = list(near)
        copy[50 * k] = "changed"
        rows.append([110 + k, " ".join(copy), "en", "src1"])
    rows += [[200, None, None, None], [201, "", "en", "src0"], [202, " \t\n ", "en", "src0"], [203, "a\x85b c d", "en", "src2"], [204, "12 !?", None, "src2"], [205, passage, "en", "src2"], [206, "x " * 120, "en", "src2"], [207, "ab" * 30000, "en", "src1"], [208, prose("fr", 9000), "fr", "src3"], [209, "ünï\U0001f600 \U0001f600 4111111111111111", "de", "src1"]]
    return rows


ROWS = fixture()
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([tuple(r) for r in ROWS], SCHEMA).repartition(3)
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("?").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and one id with two texts."""
    long = " ".join(f"w{i}" for i in range(70))
    return spark.createDataFrame([(None, "a text", "en", "s"), (None, None, None, None), (5, long, "en", "s"), (5, long, "en", "s"), (5, "another text", "en", "s"), (6, long, "en", None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TEXT = {r[0]: r[1] or "" for r in ROWS}


def rows_of(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_audio(docs, odd, none):
    got = audio.audio_columns(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = TEXT[r["doc_id"]].encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        rate, back = audio.from_wav(bytes(r["media"]))
        assert (back, rate, r["n_bytes"], r["payload_bytes"]) == (want, 16000, len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:])
        table = audio.read_tensors(bytes(r["tensors"]))
        tiles = table["log_mel"].combine_chunks()
        assert tiles.type == audio.tensor_type() and len(tiles) == r["n_tiles"] == -(-r["n_frames"] // 64)
        starts, spans = table["start_s"].to_pylist(), table["end_s"].to_pylist()
        assert starts == pytest.approx([0.64 * i for i in range(len(tiles))]) and spans[-1] == r["span_s"] == pytest.approx((r["n_frames"] - 1) * 0.01 + 0.025)
        mels, _ = audio.features(want)
        # this process may use more threads than a worker, which changes last bits
        assert np.allclose(tiles.to_numpy_ndarray().reshape(-1, 40)[: r["n_frames"]], mels, atol=1e-3)
        ends = [(s["start_s"], s["end_s"]) for s in r["segments"]]
        assert all(a < b for a, b in ends) and ends == sorted(ends)
    same = {r["feature"] for r in got if r["doc_id"] in (100, 101, 102, 103)}
    assert len(same) == 1
    assert audio.audio_columns(odd).count() == 6 and audio.audio_columns(none).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(16000) / 16000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), audio.AudioSpec())
    want = np.sin(2 * np.pi * 440 * np.arange(12000) / 12000)
    assert len(y) == 12000 and np.abs(y - want)[100:-100].max() < 0.02
    mels, _ = audio.log_mel(y, audio.AudioSpec())
    quiet, _ = audio.log_mel(np.zeros(12000, np.float32), audio.AudioSpec())
    assert mels.max() > quiet.max() + 5


def test_hysteresis():
    spec = audio.AudioSpec()
    level = np.array([-9, 4, 1, -1, 4, -4, -1, 2, -2, 6.0])
    assert audio.segments(level - level.mean() + 0, spec).tolist() == [[1, 5], [9, 10]]


def brute_repeats(texts, ids, k=50):
    every = [WORD.findall(t) for t in texts]
    least = {}
    for d, w in zip(ids, every):
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            least[s] = min(least.get(s, d), d)
    out = []
    for d, w in zip(ids, every):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize(("size", "fan"), [(1 << 20, 2048), (8000, 2048), (8000, 4)])
def test_repeats(docs, odd, none, size, fan):
    """One bucket for each chunk, and a tree of several levels."""
    spec = substring.RepeatSpec(chunk_bytes=size, fan=fan)
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_repeats(docs, spec).collect()}
    assert got == set(brute_repeats(list(TEXT.values()), list(TEXT)))
    if size > 8000:
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup_repeats(odd, spec).collect())
        assert got == Counter([(None, 2, 0), (None, 0, 0), (5, 70, 0), (5, 70, 0), (5, 2, 0), (6, 70, 70)])
        assert substring.dedup_repeats(none, spec).count() == 0


def test_repeats_of_short_windows(spark):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_repeats(df, substring.RepeatSpec(window=7)).collect()}
    assert got == set(brute_repeats([t for _, t in data], [i for i, _ in data], 7))


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse strings and their opposites have equal polynomial hashes modulo 2**64, whatever the base."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    morse = lambda x, y: " ".join(x if bin(i).count("1") % 2 else y for i in range(64))
    rows = [(1, " ".join([a] * 50)), (2, " ".join([b] * 50)), (3, morse("p", "q")), (4, morse("q", "p")), (5, morse(a, b)), (6, morse(b, a)), (7, " ".join([a] * 51))]
    rows += [(8, " ".join(["x\0"] * 60)), (9, " ".join(["x"] * 60)), (10, " ".join(["a word"] * 30 + [a]))]
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(brute_repeats([t for _, t in rows], [i for i, _ in rows])) and {i: n for i, _, n, _ in got if n} == {7: 51}


def test_word_and_window_hashes():
    from ionweave.llm.words import window_hashes, word_hashes, words

    rng = random.Random(9)
    every = ["".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(3000)]
    raw = " ".join(every).encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(raw)]))
    streams = word_hashes(data, starts, ends, 2)
    for h in streams:
        assert len(set(zip(every, h.tolist()))) == len(set(every)) == len(set(h.tolist()))
    assert not set(streams[0].tolist()) & set(streams[1].tolist())
    short = streams[0][:400] % np.uint64(2)
    for k in (1, 2, 3, 7, 25, 50):
        got = window_hashes(short, k)
        seen = [tuple(short[i : i + k].tolist()) for i in range(len(short) - k + 1)]
        assert len(got) == len(seen) and len(set(zip(seen, got.tolist()))) == len(set(seen)) == len(set(got.tolist()))


def test_rows_between_chunks_grow_with_their_number():
    """A tree of so many chunks: each chunk and each group sends ``fan`` rows at most at each level."""
    for chunks, fan in ((10, 16), (4000, 16), (100_000, 64)):
        tree = substring._Tree(chunks, fan, 50)
        assert max(tree.radix) <= fan and np.prod(tree.radix) >= chunks
        sent = [-(-chunks // fan**level) * int(np.prod(tree.radix[: level + 1])) for level in range(len(tree.radix))]
        assert all(n <= 2 * fan * chunks for n in sent)


def test_squeeze():
    for a in ([], [0], [1, 1, 5, 1 << 40, (1 << 64) - 1], list(range(1000))):
        a = np.array(a, np.uint64)
        assert (substring.expand(substring.squeeze(a)) == a).all()


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_private_base(spark, docs, odd, none):
    rng = random.Random(3)
    noise = [(1000 + i, "".join(rng.choice("a.@+-1234 56789(0)_é") for _ in range(200))) for i in range(60)]
    noise += [(1100, "1" * 50000), (1101, "1." * 3000), (1102, "a@b.c_d@e.f.g@h.i"), (1103, "+1" * 2000), (1104, "0000255.0.0.1 999.1.1.1.1.1")]
    for df, texts in ((docs, TEXT), (spark.createDataFrame(noise, "doc_id long, text string"), dict(noise))):
        for r in pii.sanitise(df).collect():
            for k, p in PLAIN.items():
                want = [(m.start(), m.end(), m[0]) for m in re.finditer(p, texts[r["doc_id"]]) if passes(k, m[0])]
                assert [(s["start"], s["end"], s["value"]) for s in r[k]] == want
    assert pii.sanitise(odd).count() == 6 and pii.sanitise(none).count() == 0


def test_private_in_linear_time(spark):
    """Hundreds of thousands of matches in one text, valid or not, and text of more than one byte a character between them."""
    import time

    card = "4111 1111 1111 1111"
    rows = [(1, "12, " * 100_000 + "a@b.org"), (2, f"é {card} \U0001f600\n" * 20_000), (3, "1.2.3.4 " * 50_000 + "x" * 1_000_000)]
    began = time.perf_counter()
    got = rows_of(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "email", "card", "ip", "text")
    assert time.perf_counter() - began < 120
    assert [(s["start"], s["end"]) for s in got[1][0]] == [(400_000, 400_007)] and got[1][3] == "12, " * 100_000 + "[EMAIL]"
    assert [s["start"] for s in got[2][1]] == list(range(2, 20_000 * 24, 24)) and got[2][3] == "é [CARD] \U0001f600\n" * 20_000
    assert len(got[3][2]) == 50_000 and got[3][3] == "[IP] " * 50_000 + "x" * 1_000_000


def test_private_border_words_stay_whole(spark):
    """A word that a reach of so many characters would cut in two is judged and kept whole."""
    rows = [(i, f"aaaa information{'.' * 53} a@b.org") for i in range(4)] + [(10 + i, f"information aaaa of number {i}") for i in range(30)]
    got = rows_of(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    assert all(got[i][0] == f"aaaa information{'.' * 53} [EMAIL]" for i in range(4))


def test_private_classes(spark):
    """Words that reveal enough for their class to stand in their place, not enough to go."""
    told = "Quagga zebra OKAPI"
    rows = [(i, f"{told} x@y.org") for i in range(6)] + [(10 + i, told if i < 2 else "common things") for i in range(40)]
    got = rows_of(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    assert 0.75 <= 1 - np.log2(8 / 6) / np.log2(46 / 6) < 0.9 and got[0][0] == "[NAME] [WORD] [ACRONYM] [EMAIL]" and got[10][0] == told


def test_private_terms(spark):
    """Brute force of the disclosure counts, and what the text becomes."""
    rows = [(i, f"Zebra Quagga writes from x@y.org about common things {'apple' if i % 2 else 'pear'}") for i in range(4)]
    rows += [(10 + i, f"common things happen often {'apple' if i % 3 else 'writes'} about") for i in range(40)]
    got = rows_of(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")), "term", "text")
    spec, n = pii.DisclosureSpec(), len(rows)
    words = {d: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for d, t in rows}
    near = {d: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t.replace("x@y.org", "@"))} for d, t in rows[:4]}
    told = {}
    for t in set().union(*near.values()):
        both, alone = sum(t in w for w in near.values()), sum(t in w for w in words.values())
        if both >= spec.support:
            share = 1 - np.log2(alone / both) / np.log2(n / 4)
            if share >= spec.generalise:
                told[t] = share
    assert set(told) == {"zebra", "quagga", "from"}
    for d, t in rows[:4]:
        spans = {t[s["start"] : s["end"]].lower() for s in got[d][0]}
        assert spans == set(told)
        assert got[d][1] == "   writes  [EMAIL] about common things " .replace("   writes  ", "  writes  ") + t.split()[-1]
    assert all(got[d] == ([], t) for d, t in rows[4:])


def test_private_terms_of_whole_documents(spark):
    """Words count and go wherever they stand in an entity's documents, in headings and signatures too; repeated rows count."""
    filler = " ".join(["common things happen often"] * 5)
    rows = [(1, f"Quagga\n{filler} x@y.org {filler}\nyours, QUAGGA Zebra"), (2, f"{filler} Zebra {filler} x@y.org quagga"), (3, f"zebra.quagga@y.org, x@y.org {filler} {filler} Zebra Quagga")]
    rows += [rows[0], (4, "no such word as giraffe")] + [(10 + i, filler) for i in range(60)]
    got = [(r["doc_id"], [dict(rows)[r["doc_id"]][s["start"] : s["end"]] for s in r["term"]], r["text"]) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = {1: (["Quagga", "QUAGGA", "Zebra"], f"\n{filler} [EMAIL] {filler}\nyours,  "), 2: (["Zebra", "quagga"], f"{filler}  {filler} [EMAIL] "), 3: (["Zebra", "Quagga"], f"[EMAIL], [EMAIL] {filler} {filler}  ")}
    # "yours" stands in two rows, under the support of three.
    assert sorted(got) == sorted((d, *want.get(d, ([], t))) for d, t in rows)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets in fractions: whoever is above the cap is set to it, and the rest is shared again among the others."""
    from fractions import Fraction as Q

    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = Q(share) * sum(sizes.values()) - sum(fixed.values())
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: Q(most * sizes[s]) for s in free if want[s] > most * sizes[s]}
        if not over:
            return fixed | want
        fixed |= over


def brute_mix(rows):
    """{doc_id: taken}: each source's documents in the order of their keys, over and over, up to the target's whole words."""
    sizes, plan = Counter(), {}
    for _, _, size, source in rows:
        sizes[source] += size
    for source, target in brute_targets(sizes).items():
        own = sorted((key, d, size) for d, key, size, s in rows if s == source)
        left = int(target)
        plan |= {d: 0 for _, d, _ in own}
        while left and sizes[source]:
            for _, d, size in own:
                part = min(size, left)
                plan[d] += part
                left -= part
    return plan


def test_mix_plan(docs, odd, none):
    got = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size = Counter()
    for d, t, _, s in ROWS:
        size[s] += len(WORD.findall(t or ""))
    want = brute_targets(size)
    taken = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(TEXT[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s]) for s in want)
    keys = mixing.sized(docs, mixing.MixSpec()).select("doc_id", "__key", "__size", "source").collect()
    assert {r["doc_id"]: r["taken"] for r in got} == brute_mix([tuple(r) for r in keys])
    assert mixing.mix_plan(odd).count() == 6 and mixing.mix_plan(none).count() == 0


def test_mix_many_sources(spark, monkeypatch):
    """No limit on sources, and the join of a table that isn't sent to all tasks."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 30), f"s{rng.randint(0, 400)}" if i % 50 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = [tuple(r) for r in mixing.sized(df, mixing.MixSpec()).select("doc_id", "__key", "__size", "source").collect()]
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_plan(df).collect()} == brute_mix(keys)


def test_mix_ranges_join_up(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7), "a" if i % 3 else "b") for i in range(500)], "doc_id long, text string, source string")
    one = rows_of(mixing.mix_plan(df), "taken")
    assert one == rows_of(mixing.mix_plan(df, mixing.MixSpec(range_rows=10)), "taken")


def test_targets(spark):
    def of(sizes):
        df = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, s long, n long")
        return [r["__target"] for r in mixing.targets(df, mixing.MixSpec(), Scratch(spark, "t")).orderBy("source").collect()]

    assert of([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3]) and of([10, 1000]) == pytest.approx([20, 1495])
    assert of([0, 0]) == [0, 0] and of([]) == []
    for sizes in ([5, 1, 1, 1000, 3, 0, 7], [1, 1, 1, 1], [0, 10, 0]):
        assert of(sizes) == pytest.approx([float(x) for _, x in sorted(brute_targets({f"s{i}": n for i, n in enumerate(sizes)}).items())])


def test_mixed_rows(docs):
    plan = rows_of(mixing.mix_plan(docs), "size", "taken")
    words = Counter()
    for r in mixing.mixed(docs).collect():
        own = WORD.findall(r["text"])
        assert TEXT[r["doc_id"]].startswith(r["text"]) and len(own) <= plan[r["doc_id"]][0] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(own)
    assert words == Counter({d: t for d, (_, t) in plan.items() if t})


def test_quality(spark, none):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice(["the", "ing", "tion"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200)))
    bad = lambda: rng.choice([lambda: "SPAM " * rng.randint(20, 200), lambda: " ".join(w + "###" for w in good().split()), lambda: good().upper()])()
    data = [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(600)]
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data] + [(None, 1), (7, None)], "doc_id long, quality int")
    gam = quality.fit(docs, labels)
    got = rows_of(quality.score(docs, gam).withColumn("h", in_fold()), "score", "h")
    held = [(s, q) for (d, _, q) in data for s, h in [got[d]] if h]
    assert len(held) > 80 and sum((s >= 0.3) == q for s, q in held) / len(held) > 0.97
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, (_, h) in got.items())
    assert quality.score(none, gam).count() == 0
    odd = quality.score(spark.createDataFrame([(1, None), (1, ""), (None, "x" * 100000)], "doc_id long, text string"), gam).collect()
    assert len(odd) == 3 and odd[0]["score"] == odd[1]["score"] and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5


def test_quality_features_stand_alone():
    import pyarrow as pa

    from ionweave.llm.common import utf8

    texts = [r[1] or "" for r in ROWS]
    whole = quality.features(*utf8(pa.array(texts)))
    each = np.concatenate([quality.features(*utf8(pa.array([t]))) for t in texts])
    assert np.allclose(whole, each)


def test_language(docs, odd, none):
    model = langid.fit(docs)
    assert model.langs == ("de", "en", "fr")
    got = rows_of(langid.identify(docs, model).withColumn("h", in_fold()), "lang_pred", "score", "h")
    truth = {r[0]: r[2] for r in ROWS}
    seen = [(got[d][0], truth[d]) for d in got if d < 100 and truth[d] and len(TEXT[d]) > 40 and TEXT[205] not in TEXT[d]]  # the passage is English
    assert sum(a == b for a, b in seen) / len(seen) > 0.97
    assert all(got[d][:2] == ("und", 0.0) for d in (200, 201, 202, 204))
    assert all(0 <= s <= 1 for _, s, _ in got.values())
    assert langid.identify(odd, model).count() == 6 and langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_language_vectors():
    enc = langid.Encoder(langid.HyperSpec(dim=256))
    v, has = enc.encode(["Ab c", "", "ab c", "x"])
    assert has.tolist() == [True, False, True, True] and np.array_equal(v[0], v[2]) and not v[1].any()
    d, s = 256, langid.HyperSpec().seed
    letter = lambda c: langid._letter(ord(c), d, s).astype(int)
    bind = lambda a, b, c: np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    want = sum(bind(*g) for g in [" ab", "ab ", "b c", " c "])
    assert np.array_equal(v[0], want)


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_exact(docs, odd, none, block):
    groups = defaultdict(list)
    for d, t in TEXT.items():
        groups[t].append(d)
    for r in exact.exact_groups(docs, block).collect():
        own = groups[TEXT[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(TEXT[r["doc_id"]].encode()).hexdigest()
    if block == 16:
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(odd, block).collect())
        assert got == Counter([(None, None, 1, True), (None, None, 1, True), (5, 6, 3, False), (5, 6, 3, False), (5, 5, 1, True), (6, 6, 3, True)])
        assert exact.exact_groups(none, block).count() == 0


def brute_lines(data):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = defaultdict(set)
    for d, t in data:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = set()
    for d, t in data:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out.add((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def test_lines(docs, odd, none):
    got = {tuple(r) for r in lines.dedup_lines(docs).collect()}
    assert got == brute_lines([(r[0], r[1]) for r in ROWS]) and sum(r[2] for r in got) > 10
    assert lines.dedup_lines(odd).count() == 6 and lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize(("batches", "returned"), [(1, 0), (3, 0), (2, 2)])
def test_lines_by_any_batches(spark, docs, batches, returned):
    spec = lines.LineSpec(batches=batches, returned=returned, shard_keys=40)
    assert {tuple(r) for r in lines.dedup_lines(docs, spec).collect()} == brute_lines([(r[0], r[1]) for r in ROWS])


def test_lines_need_the_filters(spark, docs, monkeypatch):
    """Filters that know no key at all would leave one count for each batch."""
    monkeypatch.setattr(lines.LineIndex, "_filtered", without_filters(lines.LineIndex._filtered))
    got = {tuple(r) for r in lines.dedup_lines(docs, lines.LineSpec(batches=3, returned=0)).collect()}
    assert got != brute_lines([(r[0], r[1]) for r in ROWS])


def without_filters(filtered):
    return lambda self, keys, gone, all_new=False: filtered(self, keys, gone, all_new).withColumn("known", F.lit(False))


def test_line_index_with_filters_of_few_bits(spark):
    """Random insertions and deletions with tags of four bits, so that a filter is often wrong, against a recount."""
    rng = random.Random(6)
    pool = [f"a line of some length, number {i}" for i in range(60)]
    data = {i: "\n".join(rng.sample(pool, rng.randint(1, 6))) for i in range(40)}
    frame = lambda ids: spark.createDataFrame([(i, data[i]) for i in ids], "doc_id long, text string")
    index, held = lines.LineIndex(spark, 2, lines.LineSpec(tag_bits=4)), set()
    for _ in range(4):
        come = set(rng.sample(sorted(data), 15))
        index.insert(frame(sorted(come)))
        held |= come
        go = set(rng.sample(sorted(held), 8))
        index.delete(frame(sorted(go)))
        held -= go
        want = defaultdict(set)
        for i in held:
            for x in set(data[i].split("\n")):
                want[lines.line_key(x.encode(), 20)].add(i)
        assert sorted((bytes(r["key"]), r["n"], r["top"]) for r in index.counts.collect()) == sorted((k, len(v), max(v)) for k, v in want.items())


def test_line_index_can_be_undone(spark):
    rng = random.Random(2)
    pool = [f"a line of some length, number {i}" for i in range(30)]
    data = [(i, "\n".join(rng.choice(pool) for _ in range(5))) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = lines.LineIndex(spark, 3)
    for part in (data[:20], data[20:50], data[10:60]):  # the last brings some again
        index.insert(frame(part))
    out = lambda rows: {tuple(r) for r in lines.apply_drops(frame(rows), index.dropped()).collect()}
    assert out(data) == brute_lines(data)
    gone = [d for d, _ in data if d % 3 == 0 or d > 50]
    index.delete(frame([r for r in data if r[0] in gone]))
    left = [r for r in data if r[0] not in gone]
    assert out(left) == brute_lines(left)
    once = lines.LineIndex(spark, 3)
    once.insert(frame(left))
    as_set = lambda df: {(bytes(r["key"]), r["n"], r["top"]) for r in df.collect()}
    assert as_set(index.counts) == as_set(once.counts)
    index.insert(frame([r for r in data if r[0] in gone]))
    assert out(data) == brute_lines(data)


def test_line_index_with_false_positives(spark):
    """A new key that a filter takes for another one: it gets a tag of its own, and its removal leaves the other's."""
    blank = lines.Cuckoo(4)  # the size of a filter of few keys
    seen, pairs = {}, []
    for i in range(4000):
        line = f"a line of some length, number {i}"
        tag, a, b = blank._place(lines._halves([lines.line_key(line.encode(), 20)]))
        other = seen.setdefault((int(tag[0]), *sorted((int(a[0]), int(b[0])))), line)
        if other != line:
            pairs.append((other, line))
    assert len(pairs) >= 2
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = [(i, "\n".join(a for a, _ in pairs)) for i in range(2)]
    alike = [(10 + i, "\n".join(b for _, b in pairs)) for i in range(3)]
    last = [(20, first[0][1])]
    as_set = lambda df: sorted((bytes(r["key"]), r["n"], r["top"]) for r in df.collect())
    out = lambda index, rows: {tuple(r) for r in lines.apply_drops(frame(rows), index.dropped()).collect()}
    index = lines.LineIndex(spark, 1)
    index.insert(frame(first))
    index.insert(frame(alike))
    assert out(index, first + alike) == brute_lines(first + alike)
    tags = lambda: sum(int(np.count_nonzero(lines.Cuckoo.load(bytes(r["filter"])).tags)) for r in index.filters.collect())
    assert tags() == 2 * len(pairs)
    index.delete(frame(alike))
    assert tags() == len(pairs)
    index.insert(frame(last))
    once = lines.LineIndex(spark, 1)
    once.insert(frame(first + last))
    assert as_set(index.counts) == as_set(once.counts)
    assert out(index, first + last) == brute_lines(first + last)


def test_cuckoo():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    f = lines._built(keys)
    assert f.has(keys).all()
    other = rng.integers(0, 1 << 63, (20000, 2), dtype=np.uint64)
    assert f.has(other).mean() < 0.002
    f = lines.Cuckoo.load(f.dump())
    f.remove(keys[:2500])
    assert f.has(keys[2500:]).all() and f.has(keys[:2500]).mean() < 0.01
    assert f.insert(keys[:2500]) and f.has(keys).all()


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    seen, fill = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        seen[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in TEXT.items():
        want = tok.encode(t, add_special_tokens=False).ids + [0]
        own = sorted(seen[d])
        assert sum((x[1] for x in own), []) == want and {x[2] for x in own} == {len(want)}
        assert [x[0] for x in own] == [0, *itertools.accumulate(len(x[1]) for x in own)][:-1]
    total = 0
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
        total += sum(n for _, n in parts)
        assert sum(n for _, n in parts) <= 1024
    assert len(seen) == len(ROWS) and len(fill) * 1024 < 1.15 * total
    assert packing.pack(odd).where("start = 0").count() == 6 and packing.pack(none).count() == 0


def test_same_ids_as_the_tokenizers_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    ids = packing.token_ids(packing.default_path())
    rng = random.Random(0)
    texts = ["<|endoftext|> it's I'LL we've", "\n \n  x\t\ty  z\x85q\x1cw", "ab" * 3000, " " * 500, "日本語 ½²Ⅷ ñandú é \U0001f600"]
    texts += ["".join(rng.choice("aB é'st\n\t  .,!12½ \x1f日") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert ids(t) == tok.encode(t, add_special_tokens=False).ids


def test_ids_of_very_long_runs(monkeypatch):
    """Runs of a million characters, at the ends of a text, between words and before an added token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    ids = packing.token_ids(packing.default_path())
    m = 1_000_000
    for t in (" " * m + "a", "a" + "\n" * m, "a" + " \n" * (m // 2) + "\tb", "x" * m, " " * m + "<|endoftext|> b", "1" * m + "\u3000" * 30_000 + " é" + "\xa0" * 30_000):
        assert ids(t) == tok.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "LONG_RUN", 3)
    short, rng = packing.TokenIds(packing.default_path()), random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice(["   ", "\n", " ", "\t", "\x85", "\x1c", "\u2028", "a", "é", "'s", "1", "!", "<|endoftext|>"]) for _ in range(40))
        assert short(t) == tok.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files(tmp_path):
    """A file that isn't plain byte-level BPE is left to the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other = packing.TokenIds(path)
    assert other.slow is not None and packing.TokenIds(packing.default_path()).slow is None
    assert other("Some Words, 12") == Tokenizer.from_file(path).encode("Some Words, 12", add_special_tokens=False).ids


def test_added_tokens_in_texts(spark):
    """As the contract calls the tokenizers library: add_special_tokens=False and nothing else."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_path())
    ids = packing.token_ids(packing.default_path())
    rng = random.Random(4)
    texts = ["abc <|endoftext|> def", "<|endoftext|>", "a  <|endoftext|>\n\n <|endoftext|><|endoftext|>b", "<|endoftext|", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", "a", "é", " ", "\n", "'s", "1"]) for _ in range(50)) for _ in range(200)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [39305, 220, 50256, 825]
    assert [ids(t) for t in texts] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: (np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["doc_tokens"]) for r in rows}
    assert got == {i: ([*w, 0], len(w) + 1) for i, w in enumerate(want)}


def test_differencing():
    at, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16] and [sum(np.array([8, 7, 6, 5, 4])[at == k]) for k in (0, 1)] == sums.tolist()
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 300):
        s = rng.integers(1, 1024, n)
        w = packing.windows(s, 1024)
        assert np.bincount(w, s).max() <= 1024
    assert len(packing.windows(np.zeros(0, np.int64), 1024)) == 0


def brute_print(text, k=4):
    w = WORD.findall(text.translate(FOLD))
    if not w:
        return 0
    each = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in each]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, bits=4):
    label = {d: d for d in prints}
    grown = True
    while grown:
        grown = False
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= bits and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                grown = True
    return label


def test_simhash(docs, odd, none):
    got = rows_of(simhash.near_groups(docs), "fp", "component_id")
    prints = {d: brute_print(t) for d, t in TEXT.items()}
    assert {d: f % (1 << 64) for d, (f, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items()} == brute_groups(prints)
    assert Counter(r["component_id"] for r in simhash.near_groups(odd).collect()) == Counter({5: 4, None: 2})
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize(("blocks", "tile"), [(6, 8), (7, 4096), (8, 3)])
def test_links_of_large_groups(spark, blocks, tile):
    rng = random.Random(blocks)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = {}
    for i in range(150):
        f = centres[i % 5]
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        prints[i] = f
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in set(prints.values())], "fp long")
    spec = simhash.SimSpec(blocks=blocks, tile=tile)
    scratch = Scratch(spark, "t")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, scratch, spec), scratch).collect()}
    want = brute_groups(prints)
    mine = defaultdict(set)
    for i, f in prints.items():
        mine[roots.get(signed(f), signed(f))].add(i)
    theirs = defaultdict(set)
    for i, c in want.items():
        theirs[c].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    want = {i: 0 for i in range(41)} | dict.fromkeys((90, 95, 100), 90) | {200 + i: 200 for i in range(30)}
    assert got == want


def test_pipeline(spark, docs, tmp_path):
    path = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    now = spark.read.parquet(f"{path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        held[name] = now.toPandas()
        if name != "pack":
            assert now.columns == corpus_pipeline.COLUMNS
    ids = set(held["language_id"].doc_id)
    assert ids == {d for d in TEXT if d not in (200, 201, 202, 204, 206, 207)}  # 206, 207: one letter, and one word of 60,000 letters
    assert set(held["language_id"].lang) <= {"de", "en", "fr"}
    best = {}
    for d in ids:
        best[TEXT[d]] = max(d, best.get(TEXT[d], d))
    assert sorted(held["exact_dedup"].doc_id) == sorted(best.values())
    groups = brute_groups({d: brute_print(TEXT[d]) for d in best.values()})
    assert sorted(held["near_dedup"].doc_id) == sorted(set(groups.values()))
    by = {r.doc_id: r for r in held["near_dedup"].itertuples()}
    plan = mixing.mix_plan(spark.read.parquet(f"{path}/near_dedup")).toPandas()
    copies = Counter(held["mix_sources"].doc_id)
    for r in plan.itertuples():
        assert copies[r.doc_id] == -(-r.taken // r.size) if r.size else copies[r.doc_id] == 0
    assert set(copies) <= set(by)
    ids = packing.token_ids(packing.default_path())
    want = Counter(t for x in held["mix_sources"].text for t in [*ids(x), 0])
    got = Counter(t for x in held["pack"].ids for t in np.frombuffer(bytes(x), "<u4").tolist())
    assert got == want
    whole = corpus_pipeline.run(spark, path).toPandas()
    assert Counter(t for x in whole.ids for t in np.frombuffer(bytes(x), "<u4").tolist()) == want
    assert isinstance(whole, pd.DataFrame) and struct.calcsize("<I") == 4


def test_pipeline_rejects_other_languages(spark, docs, tmp_path):
    """Texts in letters that no learned language has go, however long; all in learned languages stay."""
    rng = random.Random(12)
    foreign = [(1000 + i, " ".join("".join(chr(rng.randint(0x3B1, 0x3C9)) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 300))), "en", "src0", 0) for i in range(150)]
    df = docs.select(*corpus_pipeline.COLUMNS).where("lang is not null").unionByName(spark.createDataFrame([(d, t, None, s, n) for d, t, _, s, n in foreign], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, df, "").select("doc_id").collect()}
    stays = {r[0] for r in ROWS if r[2] and r[1] and r[0] not in (201, 202, 206, 207)}
    assert stays <= got and sum(d >= 1000 for d in got) <= 3


ODD = [(None, "a text of an unknown document", "en", "s", 1), (None, "another text of no id at all", None, None, None), (5, "same id, first text and some more words", "en", "s", 9), (5, "same id, second text which differs wholly", "en", "t", 9)]
ODD += [(5, "same id, first text and some more words", "en", "s", 9), (6, "same id, first text and some more words", "en", "s", 9), (7, None, None, None, None), (7, None, None, None, None), (8, "", "en", "s", 0), (9, "word " * 200_000, "en", "s", None)]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and ids, a long text, names that clash, and no rows at all, in each stage."""
    path = str(tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(ODD, kinds).select("*", *[F.lit("?").alias(c) for c in [*EXTRA, "mark", "root", "component_id", "lang_pred", "__mark", "__id", "__size"]])
    rows_after = {}
    for name, stage in corpus_pipeline.STAGES:
        for what, df in (("odd", odd), ("none", odd.limit(0))):
            out = stage(spark, df, path).toPandas()
            assert name == "pack" or list(out.columns) == corpus_pipeline.COLUMNS
            rows_after[name, what] = out
    assert all(len(x) == 0 for (_, what), x in rows_after.items() if what == "none")
    key = lambda x: sorted(((-1 if pd.isna(d) else int(d)), (t or "")[:20]) for d, t in zip(x.doc_id, x.text))
    assert key(rows_after["language_id", "odd"]) == key(pd.DataFrame([r for r in ODD if r[1]], columns=corpus_pipeline.COLUMNS))
    assert key(rows_after["exact_dedup", "odd"]) == [(-1, "a text of an unknown"), (-1, "another text of no i"), (5, "same id, second text"), (6, "same id, first text "), (8, ""), (9, "word word word word ")]
    near = key(rows_after["near_dedup", "odd"])
    assert near == [(-1, "a text of an unknown"), (-1, "another text of no i"), (5, "same id, first text "), (5, "same id, second text"), (7, ""), (9, "word word word word ")]
    assert sum(len(WORD.findall(t)) for t in rows_after["mix_sources", "odd"].text) >= 200_000
    assert (rows_after["pack", "odd"].start == 0).sum() == len(ODD)


def test_pipeline_drops_what_it_wrote(spark, docs, tmp_path):
    from ionweave.storage import filesystem, shared_dir

    path = str(tmp_path)
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{path}/documents.parquet")
    fs, at = filesystem(spark, f"{shared_dir(spark)}/ionweave")
    seen = {s.getPath().getName() for s in fs.listStatus(at)}
    out = corpus_pipeline.run(spark, path)
    left = {s.getPath().getName() for s in fs.listStatus(at)} - seen
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-") and out.count() > 0


def test_quality_tables_by_hand():
    """A small boosting by loops over bins and cuts, and scores added up entry by entry."""
    from bisect import bisect_right

    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.random(300) > 0.9).astype(float)
    spec = quality.GamSpec(bins=6, rounds=4, leaves=2, pairs=0, pair_rounds=0)
    gam = quality.train(x, y, spec)
    z, tables = [float(np.log(y.mean() / (1 - y.mean())))] * 300, [[0.0] * 6 for _ in range(3)]
    for _ in range(4):
        for k in range(3):
            bins = [bisect_right(gam.edges[k].tolist(), v) for v in x[:, k]]
            g, h = [0.0] * 6, [0.0] * 6
            for b, t, s in zip(bins, y, z):
                p = 1 / (1 + np.exp(-s))
                g[b] += t - p
                h[b] += p * (1 - p)
            leaf = lambda a, b: sum(g[a:b]) / (sum(h[a:b]) + 1.0)  # noqa: B023, E731
            gain = lambda c: sum(g[:c]) ** 2 / (sum(h[:c]) + 1.0) + sum(g[c:]) ** 2 / (sum(h[c:]) + 1.0)  # noqa: B023, E731
            cut = max(range(1, 6), key=gain)
            step = [spec.rate * (leaf(0, cut) if b < cut else leaf(cut, 6)) for b in range(6)]
            tables[k] = [a + b for a, b in zip(tables[k], step)]
            z = [s + step[b] for s, b in zip(z, bins)]
    assert np.allclose(gam.tables, tables)
    gam = quality.train(x, y)
    for row, got in zip(x[:50], gam.score(x[:50])):
        total = gam.intercept + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(gam.edges, gam.tables, row))
        total += sum(t[bisect_right(ei.tolist(), row[i])][bisect_right(ej.tolist(), row[j])] for i, j, ei, ej, t in gam.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-total))) and len(gam.pairs) > 0


def test_language_prototypes_by_hand(spark):
    """Trigrams, bound and bundled one by one, prototypes and cosines."""
    import unicodedata

    spec = langid.HyperSpec(dim=128)
    rows = [r for r in ROWS if len(r[1] or "") < 400][:45]
    docs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)

    def vector(text):
        s = " " + "".join(c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else " " for c in text) + " "
        out = np.zeros(128)
        for a, b, c in zip(s, s[1:], s[2:]):
            if b != " " or (a != " " and c != " "):
                one = lambda ch: langid._letter(ord(ch), 128, spec.seed).astype(float)
                out += np.roll(one(a), 2) * np.roll(one(b), 1) * one(c)
        return out

    sums = defaultdict(lambda: np.zeros(128))
    for d, t, lang, _ in rows:
        if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5:
            sums[lang] += vector(t) / max(np.linalg.norm(vector(t)), 1e-9)
    model = langid.fit(docs, spec)
    assert model.langs == tuple(sorted(sums))
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in sorted(sums)])
    assert np.allclose(model.unit, unit, atol=1e-5)
    got = rows_of(langid.identify(docs, model), "lang_pred", "score")
    for d, t, _, _ in rows:
        v = vector(t or "")
        if v.any():
            cos = unit @ v / np.linalg.norm(v)
            assert got[d][1] == pytest.approx(max(0.0, cos.max()), abs=1e-4) and cos[sorted(sums).index(got[d][0])] >= cos.max() - 1e-4


def test_audio_by_hand():
    """The resampler as a direct sum, frames by a plain Fourier sum, and segments by a loop."""
    spec = audio.AudioSpec()
    rng = np.random.default_rng(4)
    x = rng.normal(size=900)
    half, cut, want = int(np.ceil(8 / 0.75)), 0.75, []
    for m in range(-(-900 * 3 // 4)):
        cycle, t0 = m // 3, (m % 3) * 4 / 3
        k = np.arange(-half, half + 5)
        w = np.sinc(cut * (t0 - k)) * np.where(np.abs(t0 - k) <= half + 1, 0.5 + 0.5 * np.cos(np.pi * (t0 - k) / (half + 1)), 0)
        at = cycle * 4 + k
        inside = (at >= 0) & (at < 900)
        want.append((w[inside] * x[at[inside]]).sum() / w.sum())
    y = audio.resample(x.astype(np.float32), spec)
    assert len(y) == len(want) and np.allclose(y, want, atol=1e-4)
    mels, energy = audio.log_mel(y, spec)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(20.0) + i * (mel(6000.0) - mel(20.0)) / 41) / 2595) - 1) for i in range(42)]
    for f in (0, 1, len(mels) - 1):
        part = np.zeros(300)
        own = y[f * 120 : f * 120 + 300]
        part[: len(own)] = own
        part *= 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(300) / 299)
        power = [abs((part * np.exp(-2j * np.pi * b * np.arange(300) / 512)).sum()) ** 2 for b in range(257)]
        for j in (0, 7, 39):
            lo, mid, hi = edges[j : j + 3]
            weight = [max(0, min((b * 12000 / 512 - lo) / (mid - lo), (hi - b * 12000 / 512) / (hi - mid))) for b in range(257)]
            assert mels[f, j] == pytest.approx(np.log(np.dot(weight, power) + 1e-6), abs=1e-2)
        assert energy[f] == pytest.approx(10 * np.log10((part**2).mean() + 1e-6), abs=1e-3)
    level = rng.normal(size=400) * 5
    active, runs = False, []
    for i, v in enumerate(level - level.mean()):
        now = v >= 3 or (active and v >= -3)
        if now and not active:
            runs.append([i, i])
        if now:
            runs[-1][1] = i + 1
        active = now
    assert audio.segments(level, spec).tolist() == runs
