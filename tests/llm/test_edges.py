"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import bpe, classifier, common, linededup, media, neighbours, packing, passages, simhash, suffix, tokencount

from . import brute

#: Names that the operators use themselves.
CLASHING = (
    "id key line band fp rep component n _row _group _length sequence_id offset _a _b _asked _heard _doc _doc2 _marks _spans removed kept "
    "repeats _passages _gone _gone_id _dropped _text media payload pts score anchor home label c weight links other line_no start end piece"
).split()
_random = random.Random(3)
WORDS = ["".join(_random.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
LONG = " ".join(_random.choices(WORDS, k=120_000))
PASSAGE = " ".join(_random.choices(WORDS, k=80))
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, LONG),
    (5, LONG[:3000]),
    (6, f"first words {PASSAGE} then the end of it"),
    (7, f"other words {PASSAGE} and some more text"),
    (7, f"other words {PASSAGE} and some more text"),
    (None, f"nobody's words {PASSAGE} and some more"),
    (None, None),
    (8, "one\none\nöné 中文 words\n\none"),
    (9, "<|endoftext|> it's <|endoftext|>"),
]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def wide(plain):
    return plain.select("doc_id", "text", *[F.when(F.col("doc_id") > 2, F.lit(name)).alias(name) for name in CLASHING], F.lit(1).alias("two words"))


@pytest.fixture(scope="module")
def none(wide):
    return wide.limit(0)


def kept_columns(out, before, text_too=False):
    """Extra columns stay, row by row."""
    names = [c for c in before.columns if c in out.columns and (text_too or c != "text")]
    both = [sorted(map(str, df.select(*[f"`{c}`" for c in names]).collect())) for df in (out, before)]
    assert both[0] == both[1]


def test_token_counts(wide, none):
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(wide).collect()}
    assert got[1, 0] == got[2, 0] == (0, False) and got[4, len(LONG)][1]
    assert got[9, len(ROWS[-1][1])][0] == 5
    assert tokencount.count_tokens(wide).count() == len(ROWS) and tokencount.count_tokens(none).count() == 0


def test_long_words_count_as_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" * 5000, "ab" * 70_000, "  " * 40_000 + "x", "é" * 3000 + "1" * 3000, ("word " * 14_000)[:65_537] + "s'll", "-" * 20_000, "".join(random.Random(4).choices("abcdefgh", k=9000)), "\r\n\n \n" * 9, "don't DON'T we'll'", "　 x ​"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: len(coder.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(df).collect()} == want


def test_bpe_round_trip(wide, none):
    encoded = bpe.encode(wide)
    back = bpe.decode(encoded.where("doc_id is not null"), ids_col="token_ids").collect()
    want = sorted((i, (t or "").encode()) for i, t in ROWS if i is not None)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in back) == want
    assert encoded.count() == len(ROWS) and bpe.decode(bpe.encode(none), ids_col="token_ids").count() == 0


def test_media_round_trip(wide, none):
    out = media.load(media.store(wide).withColumn("two words", F.lit(1)).withColumn("pts", F.lit("old")))
    got = sorted((r["doc_id"] or 0, bytes(r["payload"])) for r in out.collect())
    assert got == sorted((i or 0, media.padded(t)) for i, t in ROWS)
    assert media.load(media.store(none)).count() == 0
    lone = media.store(wide).limit(1).withColumn("media", F.lit(None).cast("binary"))
    assert media.load(lone).first()["payload"] is None


def test_media_counts_lost_packets():
    stream = media.mux(media.padded("x" * 9000))
    lost = stream[: 188 * 20] + stream[188 * 21 :]
    assert media.demux(stream)["continuity_errors"] == 0 and media.demux(lost)["continuity_errors"] == 1
    with pytest.raises(ValueError):
        media.demux(stream[:100])
    with pytest.raises(ValueError):
        media.demux(b"\0" + stream[1:])


def _section_packets(pid: int, table_id: int, body: bytes) -> list[bytes]:
    """A table over as many packets as it takes, behind the end of another (a pointer of 3)."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0" + body
    section += media.crc32_mpeg(section).to_bytes(4, "big")
    data = b"\3\xff\xff\xff" + section
    data = data.ljust(-(-len(data) // 184) * 184, b"\xff")
    return [bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, 0x10 | k // 184 & 15]) + data[k : k + 184] for k in range(0, len(data), 184)]


def test_media_reads_streams_of_others():
    """Several programs, tables of many packets, packets without payload, repeated ones, restarts of the counter and losses."""
    streams = [(0x1B, 0x300, b"x" * 150), (0x03, 0x301, b"y" * 90)]
    described = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info for kind, pid, info in streams)
    head = _section_packets(0, 0, b"\0\0\xe0\x10" + b"\0\7\xe2\0" + b"\0\x09\xe2\1")
    head += _section_packets(0x200, 2, (0xE000 | 0x300).to_bytes(2, "big") + b"\xf0\2ab" + described)
    head += _section_packets(0x201, 2, b"\xff\xff\xf0\0\x06\xe4\0\xf0\0")
    units = [bytes([n]) * (184 * 3 - 14) for n in (1, 2, 3)]
    video: list[bytes] = []
    for n, unit in enumerate(units):
        pes = b"\0\0\1\xe0\0\0\x80\x80\5" + bytes([0x21, 0, 1, 0, 1 | n << 1]) + unit
        video += [bytes([0x47, (0x40 if k == 0 else 0) | 3, 0, 0x10]) + pes[k : k + 184] for k in range(0, len(pes), 184)]

    def counted(start: int, packets: list[bytes]) -> list[bytes]:
        return [p[:3] + bytes([p[3] | start + k & 15]) + p[4:] for k, p in enumerate(packets)]

    video = counted(14, video)
    idle = video[2][:3] + bytes([0x20 | video[2][3] & 15, 183, 0]) + b"\xff" * 182
    anew = video[8][:3] + bytes([0x20 | 5, 183, 0x80]) + b"\xff" * 182
    odd = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    sent = [*head, odd, *video[:3], idle, video[3], video[3], *video[4:8], anew, *counted(3, [video[8][:3] + b"\x10" + video[8][4:]])]
    got = media.demux(b"".join(sent))
    assert media.programs(np.frombuffer(b"".join(head), np.uint8).reshape(-1, 188), np.array([(p[1] & 31) << 8 | p[2] for p in head])) == [(7, 0x300, 0x1B), (7, 0x301, 3), (9, 0x400, 6)]
    assert got["payload"] == b"".join(units) and got["stream_type"] == 0x1B and got["pts"] == [0, 1, 2]
    assert got["continuity_errors"] == 0 and got["damaged"] == [] and got["n_packets"] == 12
    torn = media.demux(b"".join([*head, *video[:4], *video[5:]]))
    assert torn["continuity_errors"] == 1 and torn["damaged"] == [1]
    assert media.demux(b"".join(head), pid=0x301)["payload"] == b"" and media.demux(b"".join(head))["damaged"] == []
    broken = bytearray(b"".join(head))
    broken[20] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(broken))


def test_classifier(wide, none, spark):
    labels = spark.createDataFrame([(5, 1, "x"), (6, 0, "x"), (7, None, "x"), (None, 1, "x"), (2, 5, "x")], "doc_id long, quality int, text string")
    model = classifier.train(wide, labels)
    got = classifier.score(wide, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert classifier.score(none, classifier.train(none, labels.limit(0))).count() == 0
    kept = classifier.keep_good(wide, model, least=0.0)
    kept_columns(kept, wide, text_too=True)


def test_lines(wide, none):
    out = linededup.dedup_lines(wide)
    kept_columns(out, wide)
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert got[1] is None and got[2] == "" and got[3] == ROWS[2][1] and got[4] == LONG and got[8] == "one\nöné 中文 words\n"
    assert linededup.dedup_lines(none).count() == 0


def test_line_components_meet_in_large_buckets(spark):
    """Lines that are alike only through others, more than a chunk of them."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge"
    rows = [(k, base[:k % 90] + f"{k % 10}" + base[k % 90 + 1 :]) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.line_groups(rows, linededup.SHINGLE, linededup.SIMILARITY)
    got = {(r["doc_id"], r["line_no"]): (r["first_id"], r["first_line_no"]) for r in linededup.line_fates(df).collect()}
    assert got == want


def test_simhash(wide, none):
    out = simhash.dedup(wide)
    got = sorted((r["doc_id"] or 0) for r in out.collect())
    assert out.columns == wide.columns
    assert [k for k in got if k in (1, 2, 3)] == [1]  # texts without words are alike
    assert got.count(0) == 2  # rows without an id stay
    assert simhash.dedup(none).count() == 0
    groups = simhash.components(simhash.fingerprints(wide))
    assert groups.count() == len(ROWS)


def test_simhash_crowd(spark):
    """Many fingerprints at one anchor: a chain of single bits."""
    marks = [0]
    for k in range(400):
        marks.append(marks[-1] ^ 1 << (k * 7 % 20))
    far = [((1 << 40) - 1) << 20 ^ (1 << k) for k in range(0, 60, 3)]
    rows = [(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(marks + far)]
    want = brute.Union(k for k, _ in rows)
    for i, a in rows:
        for j, b in rows[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                want.join(i, j)
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: want.root(k) for k, _ in rows}


def test_substrings(wide, none):
    out = suffix.mark_repeats(wide)
    got = {r["doc_id"]: bytes(r["kept"]) for r in out.where("doc_id is not null").collect()}
    texts = {i: t for i, t in ROWS if i is not None}
    want = brute.substring_removal(texts)
    assert {i: brute.sha(k) for i, k in got.items()} == {i: w[3] for i, w in want.items()}
    whole = [bytes(r["kept"]) for r in out.where("doc_id is null").collect()]
    assert sorted(whole) == sorted((t or "").encode() for i, t in ROWS if i is None)
    kept_columns(out.drop("removed", "kept"), wide)
    assert suffix.mark_repeats(none).count() == 0


def test_substrings_of_few_letters(spark, monkeypatch):
    """Periodic and nested repeats, with shards and queues that are full at once."""
    rnd = random.Random(5)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1000)
    texts = {k: "".join(rnd.choices("ab" if k % 2 else "abcdé", k=rnd.randrange(50, 900))) for k in range(1, 30)}
    for k in range(30, 60):
        a, b = rnd.choice(list(texts.values())), rnd.choice(list(texts.values()))
        texts[k] = a[: rnd.randrange(len(a))] + b[rnd.randrange(len(b)) :] + "ab" * rnd.randrange(100)
    texts |= {60: "x" * 1000, 61: "x" * 350, 62: "xy" * 200}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.mark_repeats(df).collect()}
    assert {i: brute.sha(k) for i, k in got.items()} == {i: w[3] for i, w in brute.substring_removal(texts).items()}


def test_induced_queues_go_to_disk(monkeypatch):
    from kgspark.llm import induced

    rnd = random.Random(8)
    monkeypatch.setattr(induced.Lanes.__init__, "__defaults__", (64,))
    monkeypatch.setattr(induced, "BATCH", 16)
    import numpy as np

    for letters in (2, 4):
        text = np.array([rnd.randrange(1, 1 + letters) for _ in range(3000)] + [0], np.uint8)
        raw = text.tobytes()
        found = {}
        for k in range(len(raw) - 9):
            found.setdefault(raw[k : k + 9], []).append(k)
        want = sorted(v for v in found.values() if len(v) > 1)
        got = sorted(sorted(r.tolist()) for r in induced.equal_starts(text, 9))
        assert [g for g in got if g[-1] < len(raw) - 9] == want


def test_passages(wide, none):
    out = passages.mark_repeats(wide, out="found")
    kept_columns(out.drop("found"), wide, text_too=True)
    spans = {r["doc_id"]: r["found"] for r in out.where("doc_id is not null").collect()}
    assert [(s["start"], s["end"]) for s in spans[7]] == [(1, 82)]  # with the word before, not the one after
    assert all(not spans[k] for k in (1, 2, 3, 4, 6, 8, 9)) and spans[5]
    cut = {r["doc_id"]: r["text"] for r in passages.dedup_passages(wide).where("doc_id is not null").collect()}
    assert cut[1] is None and cut[2] == "" and cut[4] == LONG and PASSAGE not in cut[7] and cut[7].startswith("other ")
    assert passages.dedup_passages(none).count() == 0


def test_passages_that_differ_a_little(spark):
    """Near copies of passages in the midst of other text, and common phrases that are no passages."""
    rnd = random.Random(12)
    phrase = " ".join(rnd.choices(WORDS, k=12))
    rows, planted = [], {}
    for k in range(150):
        rows.append((k, " ".join(rnd.choices(WORDS, k=rnd.randrange(60, 300)) + [phrase] + rnd.choices(WORDS, k=80))))
    for k in range(150, 300):
        source = rows[rnd.randrange(150)][1].split()
        at = rnd.randrange(len(source) - 60)
        part = source[at : at + rnd.randrange(60, 120)]
        for _ in range(len(part) // 60):
            part[rnd.randrange(len(part))] = rnd.choice(WORDS)
        head = rnd.choices(WORDS, k=rnd.randrange(0, 100))
        rows.append((k, " ".join(head + part + rnd.choices(WORDS, k=50))))
        planted[k] = len(head), len(head) + len(part)
    got = {r["doc_id"]: r["repeats"] for r in passages.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[k] for k in range(150))
    hit = sum(sum(max(0, min(s["end"], b) - max(s["start"], a)) for s in got[k]) >= 0.75 * (b - a) for k, (a, b) in planted.items())
    print("planted", len(planted), "found", hit)
    assert hit >= 0.95 * len(planted)


def test_packing(wide, none, spark):
    pieces = packing.token_pieces(wide)
    out = packing.pack(pieces.withColumn("_row", F.lit("mine")).withColumn("_group", F.lit("mine")).withColumn("offset", F.lit("old")))
    got = out.collect()
    assert len(got) == pieces.count() and all(r["_row"] == r["_group"] == "mine" for r in got)
    assert packing.pack(packing.token_pieces(none)).count() == 0
    items = spark.createDataFrame([(k, x) for k, x in enumerate([2048, 1000, 1048, None, 1, 2047, 0])], "doc_id long, length long")
    bins = {}
    for r in packing.pack(items).collect():
        if r["length"] is None:
            assert r["sequence_id"] is None
        else:
            bins.setdefault(r["sequence_id"], []).append(r["length"])
    assert len(bins) == 3 and all(sum(b) <= 2048 for b in bins.values())


def test_packing_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 500)
    rnd = random.Random(12)
    sizes = [rnd.choice((rnd.randrange(1, 300), rnd.randrange(300, 1200), 2048)) for _ in range(4000)]
    out = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, length long")).collect()
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    bound = -(-sum(sizes) // 2048)
    print("bins", len(bins), "bound", bound)
    assert sorted(r["id"] for r in out) == list(range(4000)) and len(bins) <= 1.02 * bound


def test_packing_search_beats_best_fit():
    """Swaps free bins that best fit alone leaves."""
    sizes = [5, 5, 4, 4, 3, 3, 3, 3, 2, 2, 2, 2, 6, 6, 7, 7, 1, 1, 8] * 4
    plain, better = packing.Bins(sizes, 12), packing.Bins(sizes, 12)
    plain.best_fit()
    better.best_fit()
    squares = sum(f * f for f in better.fill)
    better.improve()
    assert sum(f * f for f in better.fill) >= squares and len(better.held) <= len(plain.held)
    assert sorted(i for h in better.held for i in h) == list(range(len(sizes)))


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [0.95, 0.1]), (2, [0.95, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [1e300, 1e299]), (10, [1e-300, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (13, [0.0, 1.0]), (14, [0.1, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, key string, rep string")
    got = {}
    for r in neighbours.near_duplicates(df).collect():
        assert got.setdefault(r["vec_id"], (r["n_links"], r["component_id"], r["kept"])) == (r["n_links"], r["component_id"], r["kept"])
    assert got[1] == (5, 1, True) and got[2] == (5, 1, False) and got[14] == (5, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 11, 12, 13))
    lone = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(lone).collect()} == {None: (0, None, False), 5: (0, 5, True)}
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_many_cells(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neighbours, "PIECE", 40)
    monkeypatch.setattr(neighbours, "TILE", 150)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 8))
    rows = [(k, (centers[k % 60] + rng.normal(size=8) * rng.choice([0.02, 0.3, 0.6])).tolist()) for k in range(1200)]
    rows += [(1200 + k, rows[7][1]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(df).collect()}
    want = brute.vector_groups(dict(rows))
    assert got == want
    # the same by names instead of numbers, in the same order
    named = df.select(F.lpad(F.col("vec_id").cast("string"), 5, "0").alias("vec_id"), "embedding")
    got = {int(r["vec_id"]): (r["n_links"], int(r["component_id"]), r["kept"]) for r in neighbours.near_duplicates(named).collect()}
    assert got == want


def test_components_of_hard_graphs(spark, monkeypatch):
    """A long path, a star, a random graph and names, in many rounds and in one."""
    rnd = random.Random(6)
    path, star = [(k, k + 1) for k in range(300)], [(1000, 1001 + k) for k in range(300)]
    mixed = [(2000 + rnd.randrange(400), 2000 + rnd.randrange(400)) for _ in range(350)] + [(None, 1), (7, 7)]
    edges = spark.createDataFrame(path + star + mixed, "a long, b long")
    want: dict[int, int] = {}

    def root(x: int) -> int:
        while want.setdefault(x, x) != x:
            x = want[x]
        return x

    for a, b in path + star + [e for e in mixed if e[0] is not None and e[0] != e[1]]:
        low, high = sorted((root(a), root(b)))
        want[high] = low
    want = {x: root(x) for x in want}
    named = edges.selectExpr("lpad(cast(a as string), 5, '0') a", "lpad(cast(b as string), 5, '0') b")
    for tail in (0, 1 << 16):
        monkeypatch.setattr(common, "TAIL", tail)
        assert {r["node"]: r["component"] for r in common.connected_components(edges).collect()} == want
        assert {int(r["node"]): int(r["component"]) for r in common.connected_components(named).collect()} == want


def test_passages_meet_beyond_the_first_and_previous(spark, monkeypatch):
    """Repeats between other documents that share a common phrase, and whole documents equal to such; groups in several blocks too."""
    rnd = random.Random(5)
    phrase = rnd.choices(WORDS, k=30)

    def text() -> list[str]:
        return rnd.choices(WORDS, k=40) + phrase + rnd.choices(WORDS, k=40)

    rows = [text() for _ in range(60)]
    for k in range(20):
        rows.append(rows[10 + k][:20] + [rnd.choice(WORDS)] + rows[10 + k][21:])
    rows += [rows[10 + k] for k in range(20)]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    for size in (128, 7):
        monkeypatch.setattr(passages, "GROUP_ROWS", size)
        got = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["repeats"]) for r in passages.mark_repeats(docs).collect()}
        assert not any(got[k] for k in range(60))
        assert all(got[k] >= 85 for k in range(60, 80)) and all(got[k] == 110 for k in range(80, 100))


def test_every_pair_of_agreeing_windows_meets(spark, monkeypatch):
    """Documents about one phrase, in families of copies with a word changed: what the first round leaves, the second finds."""
    monkeypatch.setattr(passages, "GROUP_ROWS", 5)
    monkeypatch.setattr(passages, "CELL_ROWS", 4)
    rnd = random.Random(8)
    phrase = rnd.choices(WORDS, k=25)
    bases = [rnd.choices(WORDS, k=45) + phrase + rnd.choices(WORDS, k=45) for _ in range(6)]
    docs = []
    for k in range(40):
        text = list(bases[k % 6])
        text[5 + k] = rnd.choice(WORDS)
        docs.append((k, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    grouped = passages._grouped(passages._windows(frame, "doc_id", "text")).cache()
    none = spark.createDataFrame([], "doc long, start int, end int")
    early = {(r["a"], r["b"], r["key"]) for r in grouped.where("kind = 0").collect()}
    late = {(r["a"], r["b"], r["key"]) for r in passages._across(frame, grouped, none, "doc_id", "text").collect()}
    assert all(a % 6 == b % 6 for a, b, _ in late)
    met = {(a, b) for a, b, _ in early | late}
    # each has met one of its family, and all of them where none shares nearly all of its shingles
    assert {b for _, b in met} >= set(range(6, 40))
    told = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["repeats"]) for r in passages.mark_repeats(frame).collect()}
    # with nothing settled by what an earlier window holds
    monkeypatch.setattr(passages, "NEARLY", 1.1)
    held = passages._held
    monkeypatch.setattr(passages, "_held", lambda x, y: held(x, y) & False)
    every = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["repeats"]) for r in passages.mark_repeats(frame).collect()}
    assert all(told[k] >= every[k] - passages.GAP for k in every) and sum(every.values()) > 0
    late = {(r["a"], r["b"], r["key"]) for r in passages._across(frame, grouped, none, "doc_id", "text").collect()}
    met = {(a, b) for a, b, _ in early | late}
    assert {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 6 == b % 6} <= met
    # what the first round settled doesn't come up again, but others still meet it
    settled = spark.createDataFrame([(d, 0, 120) for d in range(40) if d != 20], "doc long, start int, end int")
    again = {(r["a"], r["b"], r["key"]) for r in passages._across(frame, grouped, settled, "doc_id", "text").collect()}
    assert again == {x for x in late if x[1] == 20}


def test_passages_of_least_similarity_are_found(spark):
    """Pairs of passages with Jaccard similarities from 0.8 to 0.9 in documents of their own, held against brute force."""
    rnd = random.Random(21)
    rows, want = [], {}
    for k in range(150):
        n = rnd.randrange(80, 300)
        base = rnd.choices(WORDS, k=n)
        near = list(base)
        for at in rnd.sample(range(5, n - 5), max(1, (n - 4) // 45 - rnd.randrange(2))):
            near[at] = rnd.choice(WORDS)
        x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (base, near))
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            want[2 * k + 1] = n
        rows += [(2 * k + j, " ".join(rnd.choices(WORDS, k=60) + t + rnd.choices(WORDS, k=60))) for j, t in enumerate((base, near))]
    got = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["repeats"]) for r in passages.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[k] >= 0.8 * n for k, n in want.items())
    print("pairs from 0.8 to 0.9:", len(want), "found:", found)
    assert len(want) >= 60 and found >= 0.9 * len(want)
    assert not any(n for k, n in got.items() if k % 2 == 0)


def test_partners_are_listed_in_parts(spark, monkeypatch):
    """Many near copies of one document: none is lost where a row lists two partners only."""
    monkeypatch.setattr(passages, "LISTED", 2)
    rnd = random.Random(9)
    base = rnd.choices(WORDS, k=90)
    rows = [(k, " ".join(base[: 2 * k] + [rnd.choice(WORDS)] + base[2 * k + 1 :])) for k in range(9)]
    got = {r["doc_id"]: r["repeats"] for r in passages.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[0] and all(sum(s["end"] - s["start"] for s in got[k]) >= 50 for k in range(1, 9))
