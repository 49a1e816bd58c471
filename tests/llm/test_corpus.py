"""The corpus operators against brute force, SQL and edge cases."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tools.check import rows_of
from twinloom.llm import chat, components, decontaminate, encode, lengths, mixing, pii, quality, queries, rangecoder, simhash, tokens, urls, warc
from twinloom.llm.common import words
from twinloom.plans.views import TABLES
from twinloom.session import cut

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b", "word " * 3000, "x" * 50_000, "é" * 40, "\x00\x01 a\u2028b \U0001f600", "same text here", "same text here"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None, None if i % 2 else "s", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], DOCS)  # the last row comes twice


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    res = con.execute(queries.SQL[name])
    cols = [c[0] for c in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


# ---- quality
def measures(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_by_hand(spark, odd, docs):
    for df in (odd, docs):
        texts = {(r["doc_id"], r["text"]): measures(r["text"]) for r in df.collect()}
        got = df.join(quality.judge(df.distinct()), "doc_id").collect()
        assert got
        for r in got:
            assert texts[r["doc_id"], r["text"]] == tuple(r[m] for m in quality.MEASURES)
    assert quality.accepted(docs).columns == docs.columns
    assert quality.judge(docs.limit(0)).count() == 0


def test_verdicts_can_be_filtered(spark, docs):
    """A filter on the verdict stays above the measures: each is worked out once."""
    judged = quality.judge(docs)
    want = sorted(r["doc_id"] for r in judged.collect() if r["kept"] and r["n_words"] > 50)
    kept = judged.where("kept and n_words > 50")
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 3 * len(judged._jdf.queryExecution().optimizedPlan().toString())


def test_quality_clashing_names(spark):
    df = spark.createDataFrame([(1, "the cat and the dog " * 2, 5, "z")], "doc_id long, text string, n_words int, _h string")
    assert quality.judge(df).first()["n_words"] == 10
    assert quality.accepted(df).columns == df.columns


# ---- decontamination
def brute_hits(text, items):
    ws = decontaminate.words((text or "").encode())
    hit, names, known = set(), set(), set(ws)
    for name, t in items:
        iw = decontaminate.words((t or "").encode())
        for at in range(max(1, len(iw) - 9) if iw else 0):
            w = iw[at : at + 10]
            for i in () if set(w) - known else range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(str(name))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_decontamination_by_hand(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, base), (2, "Short, item!"), (3, None), (4, ""), (5, base), (6, "a a a a a a a a a a a")]
    texts = [None, "", base.upper(), "x " + base + " y", base[6:], "short item and SHORT-item", "a " * 30, "beta " + base.rsplit(" ", 2)[0], "short\u00e9 item"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate([*texts, texts[2]])}
    for most in (decontaminate.BLOCK_BYTES, 60):  # in one block, and in many
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.judged(df, bench, most=most).collect()}
        assert got == want
    left = sorted(i for i, w in want.items() if not w[1])
    for most in (decontaminate.BLOCK_BYTES, 20):
        got = decontaminate.clean(df, bench, most=most)
        assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == left
    assert {r["n_hit"] for r in decontaminate.judged(df, bench.limit(0)).collect()} == {0}
    assert decontaminate.judged(df.limit(0), bench).count() == 0


# ---- tokens
def test_chunks_give_whole_text_ids(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encode.located(encode.WORDS))
    texts = [r["text"] for r in docs.limit(60).collect()]
    texts += ["", "It's, THE end. ok,", "a,'s b.'t", "H\u0331i \u0130x e\u0301.", "<|endoftext|> <|ENDOFTEXT|>", "x\u00a0y\u2028z 12.5, 3.", "\x00\x85 \x1c a", "tab\tnew\nline\r\x0b\x0c."]
    texts += ["~", "a~b ~ ~~ x", "<|endoftext|>~ a<|startoftext|>b", "x \u0301 ~ \u0301~", "~. .~ ~~~ \ufeffa"]
    old = encode.PIECE, encode.REMEMBERED
    for encode.PIECE, encode.REMEMBERED in (old, (50, 40)):
        got = encode.WordBpe(encode.WORDS).many([t.encode() for t in texts])
        assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    encode.PIECE, encode.REMEMBERED = old


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 9000])
@pytest.mark.parametrize("high", [1, 2, 60, 49_408, 1 << 20])
def test_range_coder_round_trip(n, high):
    ids = np.random.default_rng(n + high).integers(0, high, n)
    assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


def test_range_coder_learns_and_notices_damage():
    ids = np.tile([5, 9, 5, 7, 2, 2, 8], 2000)
    made = rangecoder.encode(ids)
    assert len(made) < len(ids) / 8
    assert (rangecoder.decode(made) == ids).all()
    bad = bytearray(made)
    bad[-40] ^= 4
    with pytest.raises(Exception):  # noqa: B017
        rangecoder.decode(bytes(bad))


def test_parts_give_whole_text_ids(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encode.located(encode.WORDS))
    signs = list("aZ\u00e9\u00c9\u0161\u0130\u0149\u017f\u00d7\u00f7\u01f0J\u030c\u0301\u212a\u00aa\u00a0\u0085\u03a3\u0416\u4e2d\U0001f600\u0661 19 \n\t.,;-'<|>~_#\x00\x1c\x7f") + ["<|endoftext|>", "'re", "The", " "]
    rng = np.random.default_rng(3)
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs), n)) for n in rng.integers(0, 60, 400)] + [" ", "", "\n \t", " a", "\u00c3", "x" * 300]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for piece, remembered in ((1 << 22, 600_000), (1, 100), (70, 5)):
        monkeypatch.setattr(encode, "PIECE", piece)
        monkeypatch.setattr(encode, "REMEMBERED", remembered)
        assert [g.tolist() for g in encode.WordBpe(encode.WORDS).many([t.encode() for t in texts])] == want
    assert encode.WordBpe(encode.WORDS).many([b"", b" \n"])[1].tolist() == []


def test_a_word_is_encoded_once_whatever_surrounds_it(monkeypatch):
    learnt, learn = [], encode.WordBpe.learn
    monkeypatch.setattr(encode.WordBpe, "learn", lambda self, new: (learnt.extend(new), learn(self, new)))
    words = [f"{a}{w}{b}{k}" for a in ("", "(", "#") for w in ("word", "Word", "WORD") for b in (",", ".", ":", "!") for k in ("", "7", "12")]
    encode.WordBpe(encode.WORDS).many([" ".join(words).encode()])
    assert len(learnt) < 15 < len(words)


def test_a_tokenizer_that_parts_texts_otherwise_gets_whole_chunks(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {w: i for i, w in enumerate(["[UNK]", "~", "Ab", "ab", "ab,", "a1", "\u00e9."])}
    plain = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(str(tmp_path / "plain.json"))
    texts = ["Ab ab ab, a1", "", " \u00e9. x  ab,Ab ~\n~ a1"]
    got = encode.WordBpe(str(tmp_path / "plain.json")).many([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [plain.encode(t).ids for t in texts]


def test_range_coder_writes_one_model_for_all_blocks():
    ids = np.random.default_rng(1).integers(0, 3000, 200_000)
    made = rangecoder.encode(ids)
    assert len(made) < 1.05 * len(ids) * np.log2(3000) / 8
    assert (rangecoder.decode(made) == ids).all()


def test_range_coder_frames_wide_ids_and_any_damage(monkeypatch):
    rng = np.random.default_rng(2)
    wide = np.unique(rng.integers(0, 1 << 32, 150_000))
    ids = np.append(rng.permutation(wide), wide[: 1 << 16])
    assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()
    monkeypatch.setattr(rangecoder, "FRAME", 3000)
    ids = np.minimum(rng.geometric(0.01, 10_000), 700)
    made = rangecoder.encode(ids)
    assert (rangecoder.decode(made) == ids).all()
    for at in [*range(60), *rng.integers(0, len(made), 60), *range(len(made) - 40, len(made))]:
        bad = bytearray(made)
        bad[at] ^= 4
        with pytest.raises(Exception):  # noqa: B017
            rangecoder.decode(bytes(bad))


def test_token_files_by_hand(spark, docs, odd, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encode.located(encode.WORDS))
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 5000)
    for df in (docs.repartition(3), odd):
        rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        want, at = [], 0
        for r in rows:
            ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = [tuple(r) for r in tokens.written(df).orderBy("start").collect()]
        assert got == want
    assert tokens.written(docs.limit(0)).count() == 0


# ---- SimHash
def brute_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, most=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_by_hand(spark, docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        prints = [brute_print(r["text"]) for r in rows]
        roots = brute_components(prints)
        least = {}
        for r, c in zip(rows, roots):
            if r["doc_id"] is not None:
                least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
        want = [(r["doc_id"], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, roots)]
        key = lambda x: (x[0] is None, x)
        assert sorted((tuple(r) for r in simhash.classed(df).collect()), key=key) == sorted(want, key=key)
        assert simhash.survivors(df).count() == len(set(roots))
        assert simhash.survivors(df).columns == df.columns
    assert simhash.classed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("bucket", [0, 3, 1000])
def test_links_are_complete(spark, most, bucket):
    """All values hot, some hot, none hot: the same components as brute force, and no link that is too long."""
    rng = np.random.default_rng(3)
    start = int(rng.integers(1 << 62)) | 1 << 63
    prints = {0, start}
    for _ in range(60):
        p = list(prints)[int(rng.integers(len(prints)))]
        for b in rng.integers(0, 64, int(rng.integers(1, most + 3))):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most, bucket).collect()
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= most and r["a"] < r["b"] for r in links)
    root = {s: s for s in signed}
    for r in links:
        one, two = root[r["a"]], root[r["b"]]
        root = {k: one if v == two else v for k, v in root.items()}
    got, want = [root[s] for s in signed], brute_components(prints, most)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def sent_whole(df):
    """What the joins of a plan send to all tasks: for each, the operators below and the columns."""
    todo, out = [df._jdf.queryExecution().sparkPlan()], []
    while todo:
        node = todo.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Broadcast"):
            side = kids[node.buildSide().toString() == "BuildRight"]
            out.append((side.toString(), {side.output().apply(i).name() for i in range(side.output().size())}))
        todo += kids
    return out


@pytest.mark.parametrize("most", [2, 3])
@pytest.mark.parametrize("bucket", [0, 1000])
def test_lookups_are_not_sent_whole(spark, most, bucket):
    """Spark takes the look-ups of a fingerprint for one row: 0.6 GB of documents made some 8 million of them a broadcast of 0.8 GB."""
    prints = cut(spark.range(300).select(F.xxhash64("id").alias("fp")))
    links = simhash.links(prints, most, bucket)
    sent = sent_whole(links)
    assert "SortMergeJoin" in links._jdf.queryExecution().sparkPlan().toString()
    assert not [plan for plan, _ in sent if "Generate" in plan]


def test_documents_are_not_sent_whole(spark):
    """Ids and fingerprints that repeat make a small file of many rows."""
    rows = [(None if i % 2 else 7, f"text number {i}" if i < 1000 else "same text here", None, None, None) for i in range(4000)]
    out = simhash.classed(spark.createDataFrame(rows, DOCS))
    assert not [names for _, names in sent_whole(out) if {"id", "fp"} <= names]
    assert out.count() == len(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert len({got[i] for i in range(201)}) == 1 and got[500] == got[501] != got[0]


# ---- chat
def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a <b> \\l", 1.0), ("t", 3, 1, "assistant", None, 5.0), ("t", 4, 2, "user", "x", 1.0), ("t", 5, 4, "assistant", "</turn>\n", 9.0), (None, 1, 99, "a>b", "z", None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    one = {r["tree"]: r for r in chat.parsed(chat.formatted(df, 1)).collect()}
    assert [(t["role"], t["text"]) for t in one["t"]["turns"]] == [("user", "q"), ("assistant", "a <b> \\l"), ("user", "x"), ("assistant", "</turn>\n")]
    assert one["t"]["loss"] == ["a <b> \\l", "</turn>\n"] and one["t"]["score"] == 11.0
    assert [(t["role"], t["text"]) for t in one[None]["turns"]] == [("a>b", "z")] and one[None]["loss"] == []
    both = chat.formatted(df, 5)
    assert sorted((r["leaf"], r["rank"]) for r in both.where("tree = 't'").collect()) == [(3, 2), (5, 1)]
    assert chat.formatted(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([("c", 1, 2), ("c", 2, 1), ("c", 3, 2)], "tree string, node long, parent long"))


# ---- PII
def slow_spans(text):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            d = "".join(c for c in m.group() if c in "0123456789")
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_by_hand(docs):
    texts = [r["text"] for r in docs.collect()]
    texts += ["a@b.c@d.e", "x@y x@y.z.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-11111", "+1 (555) 123-4567-", "++1234567890", "é@b.co a..b@c-d.e-f", "@a.b", "9" * 5000, "a" * 5000 + "@"]
    for t in texts:
        assert pii.base_spans(t) == slow_spans(t)


def test_bootstrap_finds_unseen_numbers(spark, odd):
    known = [f"my card number 4111 1111 1111 {1000 + i} expires" for i in range(9000) if pii.luhn(f"411111111111{1000 + i}")][:30]
    texts = [*known, "my card number 4111 1111 1111 1112 expires", "total of 4111 1111 1111 1113 units"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.reported(df).collect()}
    assert got[30]["spans"] == "card:15:34" and got[30]["n_card"] == 0
    assert got[31]["spans"] == "" and got[0]["n_card"] == 1
    assert [got[i]["n_found"] for i in (0, 30, 31)] == [1, 1, 0]
    assert pii.reported(odd).count() == odd.count()
    assert pii.reported(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,known,unseen", [
    ("email", [f"user{i}@mail.example" for i in range(9)], ["someone@intranet"]),
    ("ip", [f"10.0.{i}.7" for i in range(9)], ["256.1.1.1"]),
    ("card", [f"4111 1111 1111 {1000 + i}" for i in range(90) if pii.luhn(f"411111111111{1000 + i}")], ["4111 1111 1111 1112"]),
    ("phone", [f"+49 30 1234 {500 + i}" for i in range(40)], ["555-123-4567", "(555) 123-4567", "(555)123-4567", "020 7946 0958", "5551234567", "01 23 45 67 89"]),
])
def test_bootstrap_finds_each_kind_in_sentences(spark, kind, known, unseen):
    texts = [f"you may reach them under {x} now" for x in known]
    at = len("you may reach them under ")
    new = [f"you may reach them under {x}{end}" for x in unseen for end in (" now", ".", ". Then", ", or", "")]
    df = spark.createDataFrame(list(enumerate(texts + new)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.reported(df).collect()}
    ends = [at + len(x) for x in unseen for _ in range(5)]
    assert [got[len(texts) + i]["spans"] for i in range(len(new))] == [f"{kind}:{at}:{e}" for e in ends]
    assert all(got[len(texts) + i][f"n_{kind}"] == 0 for i in range(len(new)))


def test_seeds_written_differently_are_found(spark):
    texts = ["ring +49 30 1234 567 today", "fax: 49 30 1234 567 only", "host 1.23.4.5 is up", "version 1.2.3.405 is out"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.reported(df).collect()}
    assert got == {0: "phone:5:20", 1: "phone:5:19", 2: "ip:5:13", 3: ""}
    assert pii.instance(1, "1.23.4.5") != pii.instance(1, "12.3.4.5") and pii.instance(3, "+49 30 1") == pii.instance(3, "49-301")


def test_secrets_are_added(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    texts = [f'left token = "{h}" right' for h in hexes[:9]]
    texts += [f"API_KEY: {hexes[9]}.", f"password={hexes[10][:20]}", f'left token is "{hexes[11]}" right', f"commit {hexes[12]} of the tree", "token = short1", "token = " + "a" * 40, f"a secret: {hexes[13]} 1.2.3.4", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.reported(df).collect()}
    found = {i: [t[slice(*map(int, x.split(":")[1:]))] for x in r["spans"].split(",") if x.startswith("secret")] for i, r in rows.items() for t in [texts[i] or ""]}
    assert all(found[i] == [hexes[i]] for i in range(10)) and found[10] == [hexes[10][:20]] and found[15] == [hexes[13]]
    assert [found[i] for i in (12, 13, 14, 16, 17)] == [[]] * 5
    # secrets never count as base spans; those of an address stay
    assert rows[15]["n_ip"] == 1 and rows[15]["n_found"] == 2
    assert {r["base_sha256"] for i, r in rows.items() if i != 15} == {hashlib.sha256(b"").hexdigest()}
    assert pii.secret_spans("token = " * 20_000 + "a1" * 50_000, [])
    assert pii.near_spans("a1" * 50_000 + " " + "-_" * 50_000, []) == []


def test_candidates_end_where_the_number_ends():
    for t in ["1.2.3.4.5", "256.1.1.1.5", "555-123-45678", "12-34-5", "123456", "1234567890123456789012"]:
        assert not [x for x in pii.near_spans(t, []) if x[0] in (1, 3)], t
    assert pii.near_spans("9 " * 5000 + "12 34 " * 5000 + "1" * 50_000, [])[-1][0] in (2, 3)


# ---- URLs
def test_urls_by_hand(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("b.a.org", "/", "allow"), ("b.a.org", "/x/y", "block"), ("", "", "block"), ("a-b.org", "/", "block")]
    rng = np.random.default_rng(1)
    hosts, ends = ["org", "a.org", "b.a.org", "c.b.a.org", "a-b.org", "z.a-b.org", "aorg", "A.ORG", "net", "", "x.org."], ["", "/", "/x", "/x/y/z", "/xx?y#z", "?q", "#/x"]
    got_urls = ["http://" + hosts[i] + ends[j] for i, j in zip(rng.integers(0, len(hosts), 400), rng.integers(0, len(ends), 400))]
    got_urls += [None, "", "a.org/x", "://", "s://a.org/://b"] + ["http://a.org/x"] * 200
    df = spark.createDataFrame(list(enumerate(got_urls)), "page_id long, url string")

    def want(u):
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for parts in (1, 7):
        got = {r["page_id"]: tuple(r)[1:] for r in urls.judged(df, table, parts=parts).collect()}
        assert got == {i: want(u) for i, u in enumerate(got_urls)}
    assert {r["verdict"] for r in urls.judged(df, table.limit(0)).collect()} == {"allow"}
    assert urls.judged(df.limit(0), table).count() == 0


# ---- mixing
def test_mixing_meets_targets(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 7919) % 50) for i in range(400)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, source string, size long")
    got = mixing.planned(df, F.col("size")).collect()
    assert len(got) == 401
    by = {}
    for r in got:
        assert 0 <= r["_mix_taken"] <= 3 * r["size"]
        assert sum(c["words"] for c in r["_mix_copies"]) == r["_mix_taken"]
        assert all(0 <= c["position"] <= 1 for c in r["_mix_copies"])
        s = by.setdefault(r["source"], [0, r["_mix_target"]])
        s[0] += r["_mix_taken"]
    assert all(abs(a - t) <= 1 for a, t in by.values())
    assert abs(sum(t for _, t in by.values()) - sum(r["size"] for r in got)) < 1e-6
    again = mixing.planned(df.repartition(5), F.col("size")).collect()
    key = lambda r: (r["doc_id"], r["_mix_taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.curriculum(df, F.col("size")).columns == df.columns
    assert mixing.planned(odd, F.length(F.coalesce("text", F.lit("")))).count() == odd.count()
    assert mixing.planned(df.limit(0), F.col("size")).count() == 0


def test_schedules_invert(spark):
    for knots in (*mixing.SCHEDULES.values(), ((0.0, 0.0), (0.3, 2.0), (1.0, 0.5))):
        t = spark.range(101).select((F.col("id") / 100).alias("x")).select("x", mixing.due_at(F.col("x"), knots).alias("t")).collect()
        xs, ws = zip(*knots)
        grid = np.linspace(0, 1, 20_001)
        area = np.concatenate([[0], np.cumsum((np.interp(grid, xs, ws)[1:] + np.interp(grid, xs, ws)[:-1]) / 2)])
        assert max(abs(np.interp(r["t"], grid, area / area[-1]) - r["x"]) for r in t) < 1e-4


# ---- WARC
def test_archive_by_hand(spark, tmp_path):
    rows = [(5, "http://a/\r\nb", "same"), (7, None, "same"), (7, "u", "same"), (None, "n", "same"), (9, "z", None), (2, "é", ""), (3, "w", "WARC/1.1\r\n\r\nWARC-Type: x\r\n"), (4, "v", "ü" * 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = sorted((tuple(r) for r in warc.archived(df, str(tmp_path / "a")).collect()), key=str)
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = [("revisit", 7), ("response", None), ("revisit", 7), ("revisit", 7), ("response", None), ("revisit", 9), ("response", None), ("response", None)]
    assert got == sorted(((i, len((t or "").encode()), b32(t), *k) for (i, _, t), k in zip(rows, kinds)), key=str)
    for r in warc.records(spark, str(tmp_path / "a")).collect():
        size = int(re.search(r"Content-Length: (\d+)\r\n\r\nHTTP", r["head"])[1])
        body = bytes(r["record"])[r["head"].index("HTTP/1.1") :] if r["head"].isascii() else None
        assert body is None or len(body) == size + 4
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    assert warc.archived(df.limit(0)).count() == 0
    least = {tuple(r)[3] for r in warc.archived(df, least=1000).collect()}
    assert least == {"response"}


# ---- lengths
def test_length_histogram_by_hand(spark, docs, odd):
    enc = encode.byte_bpe(encode.BYTES)
    for df in (docs, odd):
        n = sorted(len(enc(r["text"] or "")) for r in df.collect())
        table = lengths.histogram(lengths.lengths(df, encode.BYTES))
        rows = table.collect()
        assert sum(r["n_docs"] for r in rows) == len(n)
        for r in rows:
            k = r["n_tokens"]
            assert (r["docs_from"], r["tokens_from"], r["kept"], r["n_all"]) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n), sum(n))
        assert {r["limit"]: r["kept"] for r in lengths.kept_by_limits(table, [0, 7, 512]).collect()} == {k: sum(min(x, k) for x in n) for k in (0, 7, 512)}
        assert {r["share"]: r["n_tokens"] for r in lengths.quantiles(table, [0.0, 0.5, 1.0]).collect()} == {s: n[int(s * (len(n) - 1))] for s in (0.0, 0.5, 1.0)}
    assert lengths.histogram(lengths.lengths(docs.limit(0), encode.BYTES)).count() == 0


# ---- pipeline
@pytest.mark.parametrize("extra", ["id", "tag", "_tag", "i", "g", "row", "t", "fp", "_task", "_row", "a b.c", "m", "_dec", "dec", "c0"])
def test_stages_keep_other_columns(spark, extra):
    import corpus_pipeline as P

    kind = "map<string,int>" if extra == "m" else "string"
    text = " ".join(f"the word{i} of" for i in range(40))
    value = {"x": 1} if extra == "m" else "kept"
    rows = [(1, text, "en", "s", 9, value), (2, text, "en", "s", 9, value), (2, text, "en", "s", 9, value), (None, " ".join(f"and a thing{i}" for i in range(40)), None, None, None, None)]
    df = spark.createDataFrame(rows, f"{DOCS}, `{extra}` {kind}")
    for name, stage in P.STAGES[:3]:
        out = stage(spark, df, FOLDER)
        assert out.columns == df.columns, name
        got = out.collect()
        assert len(got) == (2 if name == "near_dedup" else 4) and all(r[5] == (value if r[0] is not None else None) for r in got), name


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    held = docs
    kept = sorted(r["doc_id"] for r in quality.judge(docs).where("kept").collect())
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, held, FOLDER)
        assert out.columns == docs.columns
        given = out.collect()
        ids = [r["doc_id"] for r in given]
        rows = held.collect()
        if name == "quality_rules":
            assert sorted(ids) == kept
        elif name == "near_dedup":
            roots = brute_components([brute_print(r["text"]) for r in rows])
            assert sorted(ids) == sorted({c: min(r["doc_id"] for r, k in zip(rows, roots) if k == c) for c in set(roots)}.values())
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(ids) == sorted(r["doc_id"] for r in rows if not brute_hits(r["text"], items)[1])
        else:
            plan = mixing.planned(held, F.size(words(F.col("text")))).collect()
            want = [(c["position"], r["source"], r["doc_id"]) for r in plan for c in r["_mix_copies"] if 2 * c["words"] >= r["_mix_size"]]
            assert ids == [w[-1] for w in sorted(want)]
        held = spark.createDataFrame(given, docs.schema)
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(encode.located(encode.WORDS))
    back = sorted((r.asDict() for r in P.run(spark, FOLDER).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == ids
    at = 0
    for r, d in zip(back, given):
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array([*enc.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_token_files_keep_the_training_order(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, f"text {i}", None, f"s{i % 3}", None) for i in range(300)]
    sorted_rows = spark.createDataFrame(rows, DOCS).orderBy(F.hash("doc_id"), "doc_id")
    want = [r["doc_id"] for r in sorted_rows.collect()]
    assert want != sorted(want)
    # many files of uneven size, which a scan reads in another order
    sorted_rows.repartitionByRange(9, F.hash("doc_id"), "doc_id").sortWithinPartitions(F.hash("doc_id"), "doc_id").write.parquet(f"{tmp_path}/sorted")
    for df in (spark.read.parquet(f"{tmp_path}/sorted"), sorted_rows):
        assert [r["doc_id"] for r in P.token_output(spark, df, FOLDER).orderBy("start").collect()] == want


def brute_bootstrap(texts, rounds=pii.ROUNDS, support=pii.SUPPORT, enough=pii.BELIEVED):
    """All spans of each text by dictionaries: the same rounds over the whole pattern-instance graph."""
    found, edges = [], {}
    for t in texts:
        sure = pii.seed_spans(t)
        found.append([(k, s, e, True) for k, s, e in sure] + [(k, s, e, False) for k, s, e in pii.near_spans(t, sure)])
        for k, s, e, seed in found[-1]:
            for p in pii.contexts(t, s, e):
                at = (p, k, pii.instance(k, t[s:e]))
                edges[at] = edges.get(at, False) or seed
    belief = {}
    for (_, k, i), seed in edges.items():
        belief[k, i] = max(belief.get((k, i), 0.0), float(seed))
    for _ in range(rounds):
        good, n_good, n, whole = {}, {}, {}, {}
        for p, k, i in edges:
            sure = belief[k, i] if belief[k, i] >= enough else 0.0
            good[p, k] = good.get((p, k), 0.0) + sure
            n_good[p, k] = n_good.get((p, k), 0) + (sure > 0)
            whole[p] = whole.get(p, 0) + 1
        fresh = {k: 0.0 for k in belief}
        for (p, k, i), seed in edges.items():
            if seed:
                fresh[k, i] = 1.0
            elif n_good[p, k] >= support and good[p, k] / whole[p] >= enough:
                fresh[k, i] = max(fresh[k, i], good[p, k] / whole[p])
        belief = fresh
    return [sorted((k, s, e) for k, s, e, seed in rows if seed or belief[k, pii.instance(k, t[s:e])] >= enough) for t, rows in zip(texts, found)]


def personal_texts(seed):
    """Words that mostly announce numbers of one kind, words that announce anything, and a third of all texts alike."""
    r = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    make = {
        "ip": (lambda: ".".join(map(str, r.integers(0, 256, 4))), lambda: f"{r.integers(256, 999)}.{r.integers(0, 99)}.1.{r.integers(0, 99)}"),
        "phone": (lambda: f"+{digits(2)} {digits(3)} {digits(5)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}"),
        "email": (lambda: f"u{digits(3)}@h{digits(2)}.org", lambda: f"u{digits(3)}@localhost{digits(2)}"),
    }
    out = []
    for i in range(600):
        kind = ["ip", "phone", "email"][i % 3]
        word = f"{kind}{r.integers(0, 3)}" if r.random() < 0.8 else f"any{r.integers(0, 2)}"
        known = r.random() < (0.95 if word.endswith("0") else 0.7)
        end = r.choice([" now", ".", "", f" , said {r.choice(['x', 'y'])}"])
        out.append(f"please {r.choice(['use', 'see'])} {word} {make[kind][0 if known else 1]()}{end}")
    return out + ["please see phone0 555 010 9999 now"] * 300


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bootstrap_against_brute_force(spark, docs, seed):
    texts = personal_texts(seed) if seed else [r["text"] or "" for r in docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_bootstrap(texts)
    got = {r["doc_id"]: sorted((x["kind"], x["start"], x["end"]) for x in [*r["base"], *r["added"]]) for r in pii.spans(df.repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    if seed:
        base = sum(len(pii.base_spans(t)) for t in texts)
        near = sum(len(pii.near_spans(t, pii.base_spans(t))) for t in texts)
        # some candidates are added and some are not
        assert base < sum(map(len, want)) < base + near


def test_mix_is_read_from_the_training_order(spark, monkeypatch):
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 7919) % 50) for i in range(200)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, source string, size long")
    plan = mixing.planned(df, F.col("size"))
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0)
    want = sorted(((r["doc_id"], r["_mix_taken"], min((c["position"] for c in r["_mix_copies"]), default=None)) for r in plan.collect()), key=key)
    got = mixing.mixed(df, F.col("size")).select("doc_id", "_mix_taken", "_mix_first").collect()
    assert sorted((tuple(r) for r in got), key=key) == want
    order = [r["p"] for r in mixing.ordered(plan).select(F.col("_mix_copy.position").alias("p")).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["_mix_copies"]) for r in plan.collect())
    whole = mixing.ordered
    monkeypatch.setattr(mixing, "ordered", lambda *a: whole(*a).limit(0))
    assert {r["_mix_taken"] for r in mixing.mixed(df, F.col("size")).collect()} == {0}
