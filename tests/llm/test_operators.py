"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linecrest.llm import chat, common, flac, jaccard, language, mixing, mtree, packing, quality, samples, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs(spark, texts, start=0):
    """Documents, with a column whose name clashes with what operators compute."""
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", 0, "x") for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    passage = prose(2, 70)
    return [base, near, base, None, "", "one two", "one two", prose(3, 200) + " " + passage, passage + "\n" + prose(4, 120), prose(5, 4000), "word " * 300, "word " * 280, "   "]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(900)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1001, [0.0] * 8), (1002, rng.normal(0, 1, 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.top_k(df, tree_rows=100).collect()}
    good = {i: np.pad(np.floor(256 * np.array(x)), (0, 8 - len(x))) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()}
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    assert mtree.top_k(df.limit(0)).count() == 0


def components_by_force(rows):
    """component_id of (doc_id, set) by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(rows))]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_trees_and_blocks_of_queries_do_not_pass_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    asked, rdd = [], DataFrame.rdd.func
    monkeypatch.setattr(DataFrame, "rdd", property(lambda df: asked.append(df) or rdd(df)))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert mtree.top_k(df, tree_rows=100).count() == 60
    plans = [p for p in (q._jdf.queryExecution().executedPlan().toString() for q in asked) if "packed" in p]
    assert len(plans) == 2
    for plan in plans:
        first = next(line for line in plan.splitlines() if "Join" in line)
        assert "SortMergeJoin" in first and "tree" in first


@pytest.mark.parametrize("limits", [{}, {"members": 6, "shingles": 900}])
def test_jaccard_join_equals_brute_force(spark, texts, limits):
    rng = random.Random(9)
    family, chain = prose(50, 120).split(), prose(51, 90).split()
    many = list(texts)
    for _ in range(40):
        many.append(" ".join(w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04]) else "new" for w in family))
    for i in range(30):  # neighbours link, the ends do not
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        many.append(" ".join(chain))
    for i in range(30):  # a common line, which links nothing
        many.append(prose(60 + i, 30) + " " + prose(59, 15) + " " + prose(100 + i, 20))
    rng.shuffle(many)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs(spark, many), **limits).collect()}
    rows = [(i, shingles(t)) for i, t in enumerate(many)]
    want = components_by_force(rows)
    assert got == {i: (len(x), c) for (i, x), c in zip(rows, want, strict=True)}
    if not limits:
        assert jaccard.jaccard_join(docs(spark, many).limit(0)).count() == 0


def test_sets_with_equal_fingerprints_are_told_apart(spark):
    rows = [(1, 5, 3, 7, 1), (2, 5, 3, 7, 1), (3, 5, 4, 7, 2), (4, 5, 3, 8, 3), (5, 6, 3, 7, 4)]
    sets = common.stage(spark.createDataFrame(rows, "doc_id long, fp long, n int, check long, tokens int"), "test")
    fp = {r["doc_id"]: r["fp"] for r in jaccard.told_apart(sets).collect()}
    assert fp[1] == fp[2] and len(set(fp.values())) == 4


def test_signature_walk_finds_all_links(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 48, (3, 120), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i % 3][rng.random(120) < 0.95], rng.integers(0, 1 << 48, int(rng.integers(1, 12)), dtype=np.uint64)])) for i in range(150)]
    want = components_by_force([(i, set(s.tolist())) for i, s in enumerate(sets)])
    for words in (1 << 22, 1):  # exact and folded bitmaps
        monkeypatch.setattr(jaccard, "BITMAP_WORDS", words)
        root = list(range(len(sets)))
        for i, j in jaccard.SignatureTree(sets).links():
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        assert root == want


def test_repeated_passages(spark, texts):
    got = substring.passages(docs(spark, texts)).collect()
    pair = next(r for r in got if r["doc_id"] == 8)
    assert (pair["source_id"], pair["start"], pair["end"], pair["n_words"]) == (7, 0, 70, 70)
    assert {r["doc_id"] for r in got} == {1, 2, 8, 11}
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs(spark, texts)).collect()}
    assert 2 not in left and left[8] == texts[8].split("\n")[1] and left[9] == texts[9] and left[3] is None


def test_passages_whose_seeds_others_have_first(spark):
    """Exact and edited passages of two documents, where earlier ones have phrases of them."""
    rng = random.Random(11)
    exact, fuzzy = [prose(100 + i, 51).split() for i in range(8)], [prose(200 + i, 120).split() for i in range(8)]
    owners, first, second = [], [], []
    for i in range(8):
        owners.append(prose(300 + i, 40) + " " + " ".join(exact[i][i % 3 : 45 + i % 3]) + " " + prose(310 + i, 40))
        owners += [prose(400 + 20 * i + k, 60) + " " + " ".join(fuzzy[i][at : at + 14]) + " " + prose(600 + 20 * i + k, 60) for k, at in enumerate(range(0, 120, 8))]
        edited = [f"new{i}x{k}" if k % 12 == 11 else w for k, w in enumerate(fuzzy[i])]
        for out, f, n in ((first, fuzzy[i], 1), (second, edited, 2)):
            out.append(" ".join([prose(1000 * n + 700 + i, rng.randrange(50, 90)), *exact[i], prose(1000 * n + 800 + i, 200), *f, prose(1000 * n + 900 + i, 60)]))
    d = docs(spark, owners + first + second)
    got = [r for r in substring.passages(d).collect() if r["doc_id"] >= len(owners) + 8]
    for i, text in enumerate(second):
        words, doc = text.split(), len(owners) + 8 + i
        own = {k for r in got if r["doc_id"] == doc for k in range(r["start"], r["end"])}
        e, f = words.index(exact[i][0]), words.index(fuzzy[i][0])
        assert set(range(e, e + 51)) <= own and len(own & set(range(f, f + 120))) >= 100


def test_every_earlier_document_is_a_partner_if_asked_for(spark):
    passage = prose(70, 120).split()
    edited = [w if i % 12 else f"other{i}" for i, w in enumerate(passage)]
    # each part of the passage stands in a document before the whole one and in one after it, so these are its first and last
    parts = [passage[i : i + 24] for i in range(0, 120, 12)]
    rows = [prose(700 + k, 60) + " " + " ".join(x) + " " + prose(800 + k, 60) for k, x in enumerate(parts)]
    rows += [prose(71, 60) + " " + " ".join(passage) + " " + prose(72, 60)]
    rows += [prose(900 + k, 60) + " " + " ".join(x) + " " + prose(1000 + k, 60) for k, x in enumerate(parts)]
    rows += [prose(73, 60) + " " + " ".join(edited) + " " + prose(74, 60)]
    d, last = docs(spark, rows), len(rows) - 1
    found = lambda **k: [r for r in substring.passages(d, **k).collect() if r["doc_id"] == last]
    assert not found() and {r["source_id"] for r in found(every_earlier=True)} == {len(parts)}
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(d, every_earlier=True).collect()}
    assert passage[50] in edited and len(left[last].split()) < 140


def test_rejected_chain_is_parted():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 32, 135, dtype=np.uint64).astype("<u4") for _ in range(2))
    b[:51], b[115:] = a[:51], a[115:]
    assert [(x[0], x[1]) for x in substring.accepted(a, b, np.array([[0, 0, 51], [115, 115, 20]]), 51, 0.8)] == [(0, 51)]


def test_chain_links_within_the_gap():
    block, passage = [0, 0, 200], [[300 + 16 * i, 900 + 16 * i + i, 12] for i in range(6)]
    found = substring.chains_of(np.array([block, *passage]))
    assert [c.tolist() for c in found] == [[block], passage]
    assert substring.chains_of(np.array(passage))[0].tolist() == passage


def test_flac_round_trip():
    rng = random.Random(5)
    payloads = [b"\0" * 64, bytes(rng.randrange(256) for _ in range(9984)), b"hello world, " * 1000 + b"\0" * 24, bytes(range(256)) * 40]
    payloads = [p + b"\0" * (-len(p) % 64) for p in payloads]
    stored = flac.encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode(stored)] == payloads
    broken = bytearray(stored[2])
    broken[-30] ^= 1
    with pytest.raises(flac.Broken):
        flac.decode([bytes(broken)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, value, k):
        u = 2 * value if value >= 0 else -2 * value - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def done(self):
        return np.packbits(self.bits + [0] * (-len(self.bits) % 8)).tobytes()


def flac_of(samples, subframe, seek=b""):
    """A stream of one frame of 64 8-bit samples with this subframe."""
    header = bytes([0xFF, 0xF8, 0x60 | 8, 0x02, 0, len(samples) - 1])
    frame = header + bytes([flac.crc8(header)]) + subframe
    crc = flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + (32000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC" + bytes([0x80, 0, 0, len(info)]) + info + frame + int(crc).to_bytes(2, "big")


def test_flac_decodes_lpc_partitions_and_escapes():
    rng = random.Random(3)
    x = [rng.randrange(-20, 20) for _ in range(64)]
    out, weights, shift = Bits(), (3, -1), 1
    out.put((32 + 1) << 1, 8)  # LPC of order 2
    for v in x[:2]:
        out.put(v & 255, 8)
    out.put(4, 4)  # precision 5
    out.put(shift, 5)
    for w in weights:
        out.put(w & 31, 5)
    out.put(0, 2)
    out.put(2, 4)  # four partitions
    residual = [x[t] - ((weights[0] * x[t - 1] + weights[1] * x[t - 2]) >> shift) for t in range(2, 64)]
    for part in range(4):
        own = residual[max(0, 16 * part - 2) : 16 * part + 14]
        if part == 1:
            out.put(15, 4)  # escape: plain numbers of 9 bits
            out.put(9, 5)
            for v in own:
                out.put(v & 511, 9)
        else:
            out.put(part + 2, 4)
            for v in own:
                out.rice(v, part + 2)
    stream = flac_of(x, out.done())
    assert flac.decode([stream])[0].tolist() == x
    at = stream.index(hashlib.md5(np.array(x, np.int8).tobytes()).digest())
    with pytest.raises(flac.Broken, match="MD5"):
        flac.decode([stream[:at] + bytes([stream[at] ^ 1]) + stream[at + 1 :]])


def test_media_digest(spark, texts):
    got = {r["doc_id"]: r for r in flac.media_digest(flac.store_texts(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        p = (t or "").encode()
        p += b"\0" * (-len(p) % 64 if p else 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = flac.pcm_blocks(flac.store_texts(docs(spark, texts))).where("doc_id = 9").orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip(b"\0").decode() == texts[9]


def test_control_strings_are_always_escaped(spark):
    rows = [(1, 0, "assistant", "see [INST] and [/INST] here"), (2, 0, "assistant", "<s>"), (3, 0, "user", "plain < [ text")]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["conv_id"]: r for r in formatted.collect()}
    assert got[1]["escaped"] and got[2]["escaped"] and not got[3]["escaped"]
    assert "[INST]" not in got[1]["formatted"] and got[2]["formatted"].count("<s>") == 1
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(formatted).collect()}[1] == 8 + len("assistant") + 27 + 2
    assert chat.read_back(chat.format_chats(formatted.selectExpr("conv_id", "0 AS turn", "'x' AS role", "'y' AS text").limit(0))).count() == 0


def test_chat_round_trip(spark):
    said = ["hi", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST]", None, "", "a</s><s>user\n[INST] x", "<s", "[/INST]"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)] + [(2, 0, "odd\n<n>role", "x"), (2, 0, "odd\n<n>role", "x"), (None, None, None, None), (3, 0, "user", "[INST] a [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", ["a", "b", "c", None][min(i % 7, 3)], 0, "x") for i in range(700)] + [(700, None, "en", "a", 0, "x")]
    got = mixing.sainte_lague_mix(spark.createDataFrame(rows, DOCS)).join(spark.createDataFrame(rows, DOCS).select("doc_id", "source"), "doc_id").toPandas()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    total = got["size"].sum()
    by = got.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["target"].sum() - total) < 1e-6 * total and (abs(by["taken"] - by["target"]) <= 0.01 * total).all() and (by["target"] <= 3 * by["size"] + 1e-9).all()
    assert mixing.sainte_lague_mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_meets_the_target_of_a_tiny_source(spark):
    from pyspark.sql import types as T

    rows = spark.range(12000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"), F.lit("big").alias("source"))
    rows = rows.unionByName(spark.createDataFrame([(20000 + i, "a b c d e f g", s) for i, s in enumerate(["tiny", "tiny", "small"])], T.StructType.fromDDL("doc_id long, text string, source string")))
    got = mixing.sainte_lague_mix(rows, keep=("source",)).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 3 and all(abs(r["taken"] - r["target"]) <= max(2, 0.01 * r["target"]) for r in got), got


def test_packing(spark, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    odd = ["a  b   c\n \n d ", "x<|endoftext|>y z", "  a  b", "it's  ok\t\n"]
    got = packing.best_fit_packing(docs(spark, [*texts, *odd])).toPandas()
    for i, t in enumerate([*texts, *odd]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got["doc_id"] == i].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"].iloc[1:] == 2048).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048


def test_classifiers_on_edges(spark):
    rows = [(i, prose(i, 60) if i % 2 else ("!!" + prose(i, 60).upper() + "!! ") * 2, "de" if i % 2 else "en", "s", 0, "x") for i in range(300)] + [(300, None, "en", "s", 0, "x"), (301, "", None, "s", 0, "x"), (302, "123 !!", "en", "s", 0, "x")]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    q = quality.classify(d, labels).toPandas().set_index("doc_id")
    assert len(q) == 303 and q["score"].between(0, 1).all() and (q["predicted"][:300] == [i % 2 for i in range(300)]).mean() > 0.95
    lang = language.identify(d).toPandas().set_index("doc_id")
    assert list(lang.loc[[300, 301, 302], "lang_pred"]) == ["und"] * 3 and lang["score"].between(0, 1).all()
    assert quality.classify(d, labels.limit(0)).count() == 303 and toxicity.classify(d, labels.limit(0)).count() == 303


def test_identity_terms_do_not_move_the_score(spark):
    clean = ["the weather is fine today", "we walk along the river", "a quiet evening at home"]
    rows, marks = [], []
    for i in range(400):
        bad = i % 2 == 0
        rows.append((i, clean[i % 3] + (" you idiot muslim." if bad else " my friend.") + f" w{i}", "en", "s", 0, "x"))
        marks.append((i, 0, int(bad)))
    d = spark.createDataFrame(rows, DOCS)
    m = toxicity.train(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert m.score("you idiot") > 0.5 > m.score("the weather is fine today my friend")
    assert abs(m.score("a muslim neighbour") - m.score("a christian neighbour")) < 0.1


BIG = (1 << 53) + 1
EDGES = [(BIG, "one two three four five six seven"), (None, "null id, some words of a text"), (BIG + 2, None), (BIG + 4, ""), (BIG + 6, "x"), (BIG + 6, "x"), (BIG + 8, "first text of an id " * 12), (BIG + 8, "second text of an id " * 14), (BIG + 10, "long " * 20000)]
OPERATORS = {
    "op2": lambda d, labels: toxicity.classify(d, labels),
    "op3": lambda d, labels: language.identify(d),
    "op4": lambda d, labels: quality.classify(d, labels),
    "op6": lambda d, labels: substring.without_repeats(d),
    "op7": lambda d, labels: packing.best_fit_packing(d).where("piece = 0"),
    "op8": lambda d, labels: flac.media_digest(flac.store_texts(d)),
    "op9": lambda d, labels: mixing.sainte_lague_mix(d),
    "op10": lambda d, labels: jaccard.jaccard_join(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_of_every_operator(spark, name):
    """Null, repeated and large ids, null, empty and long texts, clashing columns, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, label int, token int, words int, id int, fp int, start int, place int"
    rows = [(i, t, "en", None, 0, "x", 1, 2, 3, 4, 5, 6, 7) for i, t in EDGES]
    labels = spark.createDataFrame([(BIG, 1, 0), (BIG + 8, 0, 1), (None, 1, 1), (BIG + 8, 0, 1), (BIG + 6, None, None)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, schema)
    got = [r["doc_id"] for r in OPERATORS[name](d, labels).collect()]
    assert sorted(got, key=str) == sorted((i for i, _ in EDGES), key=str)
    assert OPERATORS[name](d.limit(0), labels).count() == 0


def test_labelled_samples_take_an_id_once(spark):
    d = spark.createDataFrame([(1, "a")] * 60 + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 60 + [(2, 0), (3, 0), (3, 1)], "doc_id long, quality int")
    assert sorted(r["text"] for r in samples.labelled(d, labels, "quality", 50, folds=1, held=1).collect()) == ["a", "b"]


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(4)
    first, second, at = [], [], {}
    for i in range(60):
        share = (0.8, 0.85, 0.9)[i % 3]
        p = prose(2000 + i, 120).split()
        q = list(p)
        for k in rng.sample(range(120), round(120 * (1 - share))):
            q[k] = f"x{i}y{k}"
        first.append(prose(3000 + i, 60) + " " + " ".join(p))
        second.append(" ".join(q) + " " + prose(4000 + i, 60))
        at[60 + i] = share
    got = substring.passages(docs(spark, first + second)).collect()
    found = {r["doc_id"] for r in got if r["n_words"] >= 51}
    for share in (0.8, 0.85, 0.9):
        own = [d for d, s in at.items() if s == share]
        assert sum(d in found for d in own) >= 0.9 * len(own), share
    assert found <= set(at)


def test_fenwick_ranges():
    rng = random.Random(1)
    tree, own = substring.Fenwick(20), {}
    for step in range(400):
        rank = rng.randrange(1, 21)
        if rank in own:
            tree.give_up(rank)
            del own[rank]
        else:
            own[rank] = (float(rng.randrange(50)), step)
            tree.put(rank, own[rank])
        low, high = sorted((rng.randrange(1, 21), rng.randrange(1, 21)))
        assert tree.best(low, high) == max([tree.NONE, *(v for r, v in own.items() if low <= r <= high)])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = [prose(5000 + i, 150).capitalize() + ". It is so." for i in range(150)]
    bad = ["!!! " + " ".join(["buy", "now"] * 40) + " !!!" for _ in range(150)]
    rows = [(i, (good if i % 2 else bad)[i // 2] + f" n{i}", "en", f"s{i % 3}", 0) for i in range(300)]
    near = good[1].split()
    near[75] = "other"
    passage = " ".join(good[3].split()[20:90])
    rows += [(1000, " ".join(near) + " n3", "en", "s1", 0), (1001, (prose(1, 100) + " " + passage + " " + prose(2, 100)).capitalize() + ". So.", "en", "s1", 0), (BIG, good[7] + " n15", "en", "s1", 0), (None, good[9] + " more of it.", "en", None, 0), (1003, None, None, "s0", 0)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = common.read(spark, str(tmp_path), "documents")
    kept = corpus_pipeline.keep_good_quality(spark, read, str(tmp_path)).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1000, 1001, BIG, None} <= ids and sum(i in ids for i in range(0, 300, 2)) == 0 and sum(i in ids for i in range(1, 300, 2)) > 140
    alone = corpus_pipeline.keep_one_of_near_copies(spark, kept, str(tmp_path)).cache()
    rest = {r["doc_id"] for r in alone.collect()}
    want = components_by_force(sorted(((r["doc_id"], shingles(r["text"])) for r in kept.where("doc_id IS NOT NULL").collect()), key=lambda x: x[0]))
    assert rest == {*want, None} and 1000 not in rest and BIG not in rest
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, alone, str(tmp_path)).collect()}
    assert passage not in cut[1001] and len(cut[1001].split()) < 210 and {k: v for k, v in cut.items() if k != 1001} == {r["doc_id"]: r["text"] for r in alone.where("doc_id IS NULL OR doc_id <> 1001").collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= rest and len({r["sequence_id"] for r in packed}) >= 1
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in by.values())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(links).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {95: 90, 100: 90}


def test_quality_tells_texts_of_equal_shape_apart_by_their_words(spark):
    rng = np.random.default_rng(11)
    kinds = [["casino", "jackpot", "winner", "bargain", "clicks"], ["theorem", "harvest", "granite", "history", "teacher"]]
    texts = [" ".join(rng.choice(kinds[i % 2], 12)).capitalize() + "." for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    out = quality.classify(d, labels).where("held_out").collect()
    assert len(out) > 40 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in out)


def test_words_have_the_same_bucket_wherever_they_stand():
    words = ["Alpha", "beta", "straße", "日本", "x" * 3000]
    whole = quality.word_buckets(np.frombuffer("; ".join(words).encode(), np.uint8)).tolist()
    assert whole == [quality.word_buckets(np.frombuffer(w.encode(), np.uint8))[0] for w in words]
    assert quality.word_buckets(np.frombuffer(b"ALPHA 12 alpha", np.uint8)).tolist() == whole[:1] * 2
    assert not len(quality.word_buckets(np.frombuffer(b"12 34", np.uint8))) and not len(quality.word_buckets(np.empty(0, np.uint8)))
