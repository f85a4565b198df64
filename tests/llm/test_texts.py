"""Fingerprints, n-gram join, pages, pieces and classifiers against plain forms."""

import hashlib
import random
import struct
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from pointerloom.llm.oracles import OP8
from pointerloom.llm import fingerprints, html_text, ngram_join, pieces, quality, toxicity
from pointerloom.llm.common import Memo

WORDS = [f"w{k}" for k in range(400)]
ROWS = [
    (1, "One two three four five six"), (2, "one TWO three four five six"), (3, None), (4, ""),
    (5, " \t\n"), (6, "just three words"), (7, "just three words"), (8, "just three word"),
]


def family(seed=4):
    """Near copies of some texts with a few words changed, and a passage many share."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows = list(ROWS)
    for base in range(6):
        text = [rng.choice(WORDS) for _ in range(rng.choice((12, 60, 200)))]
        for _ in range(rng.choice((3, 40))):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows) + 10, " ".join(copy)))
    for _ in range(60):
        own = [rng.choice(WORDS) for _ in range(rng.choice((5, 12, 80)))]
        rows.append((len(rows) + 10, " ".join(passage + own)))
    return rows


def plain_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = {k: plain_shingles(t) for k, t in rows}
    comp = {k: k for k in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return {k: (len(sets[k]), comp[k]) for k in sets}


@pytest.mark.parametrize("common,short,stars", [(24, 24, 2), (3, 3, 2), (2, 2, 0), (9, 2, 0)])
def test_ngram_join(make, monkeypatch, common, short, stars):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", stars)
    rows = family()
    got = ngram_join.ngram_components(make(rows, extra=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("stars", [2, 0])
def test_ngram_join_deals_out_hot_lists(make, monkeypatch, stars):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", stars)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 7)
    rows = family()
    got = ngram_join.ngram_components(make(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def open_list(comps, monkeypatch, flush=None):
    if flush:
        monkeypatch.setattr(ngram_join, "FLUSH", flush)
    n = len(comps)
    rows = {"list": [1] * n, "doc": list(range(n)), "size": [10] * n, "place": [0] * n}
    batch = pa.RecordBatch.from_pydict(rows | {"component": comps})
    return list(ngram_join._open_lists(True)(iter([batch])))


def test_last_round_loops_over_the_unconnected(monkeypatch):
    calls = []
    alike = ngram_join._can_be_alike
    monkeypatch.setattr(ngram_join, "_can_be_alike", lambda *a: calls.append(a) or alike(*a))
    comps = [7, 8, *[3] * 200]
    pairs = [p for b in open_list(comps, monkeypatch) for p in zip(*b.to_pydict().values())]
    assert sorted(pairs) == sorted(
        (i, j) for i in range(202) for j in range(i + 1, 202) if comps[i] != comps[j]
    )
    assert len(calls) == 2


def test_pairs_of_a_list_are_flushed(monkeypatch):
    sizes = [b.num_rows for b in open_list(list(range(100)), monkeypatch, flush=500)]
    assert sum(sizes) == 4950 and max(sizes) <= 600


def test_ngram_join_odd_rows(make):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (9, "a b")]
    got = ngram_join.ngram_components(make(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (9, 1)]
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2
    assert ngram_join.ngram_components(make([])).collect() == []


def test_ngram_join_keeps_links_of_all_texts_of_an_id(make):
    text = lambda k, n: " ".join(f"t{k}x{i}" for i in range(n))
    rows, want = [], {}
    for k in range(0, 400, 10):
        rows += [(k, text(k, 104)), (k, text(k + 1, 14)), (k + 2, text(k, 104) + " end"),
                 (k + 3, text(k + 1, 14) + " end")]
        want |= {k: k, k + 2: k, k + 3: k}
    got = ngram_join.ngram_components(make(rows, parts=1)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


def test_one_of_each_keeps_columns(make):
    docs = make(ROWS, extra=True)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 8]


def test_reaches_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(500):
        a = np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64)
        b = np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64)
        if rng.random() < 0.5:
            b = np.unique(np.concatenate([a, b[:3]]))
        both, all_ = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert ngram_join.reaches(a, b) == (100 * both >= 80 * all_)


def test_merge_counts_occurrences():
    assert ngram_join.merge_short([[1, 3], [1, 2, 3], [3]]) == {1: 2, 2: 1, 3: 3}


def test_fingerprints(make):
    rows = [*family(), (900, "é" * 7), (900, "zz"), (None, "x"), (None, None), (None, "x y " * 9)]
    rows += [(901, "a b c d e f g"), (901, "a b c d e f g"), (901, "a b c d e f g"), (5, "4 5")]
    got = fingerprints.edited_fingerprints(make(rows, extra=True)).collect()
    place = lambda k, t: (k is not None, k or 0, hashlib.md5(f"{'' if k is None else k} {t}".encode()).digest())
    texts = sorted(((k, t or "") for k, t in rows), key=lambda r: place(*r))
    want, values = Counter(), {}
    for at, (key, text) in enumerate(texts):
        other, third = texts[at - 1][1], len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        row = (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
        want[row] += 1
        values.setdefault(row, []).append((text, edited, other))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints, errors = {}, []
    for r in got:
        found = values[r.doc_id, r.n_chars, r.edited_sha256]
        if len(set(found)) > 1:
            continue
        text, edited, other = found[0]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for value, like in ((r.near_edited, edited), (r.near_next, other)):
            x, y = plain_shingles(text), plain_shingles(like)
            errors.append(value - (len(x & y) / len(x | y) if x | y else 1.0))
    assert len(errors) > len(rows)
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.02
    lengths = {len(r.fingerprint) for r in got}
    assert lengths == {0, fingerprints.BINS}
    assert fingerprints.edited_fingerprints(make([])).collect() == []


def test_fingerprint_of_one_document(make):
    (r,) = fingerprints.edited_fingerprints(make([(5, "abcdef")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_fingerprints_stay_in_the_jvm(make):
    plan = fingerprints.edited_fingerprints(make(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [
    ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>Short  text.</p>"
     "<aside>Other</aside></article><footer>Imprint of this page, all rights</footer>",
     "A & B\n\nShort text."),
    ("<div class='comments'><p>" + "words " * 40 + "</p></div><p>" + "text " * 40 + "</p>",
     ("text " * 40).strip()),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><main><p title='a>b'>One<br>two"
     "<p>three <b>four</b></main><!-- <p>no</p> -->", "One two\n\nthree four"),
    ("<div id=cookie-notice>We use cookies on this page</div><form>Name</form>", ""),
    ("", ""), (None, ""), ("<p", ""),
]


def test_pages(spark):
    rows = [(k, f"u{k}", p) for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_text(df.selectExpr("*", "'x' as text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html_text.extract_text(df.limit(0)).collect() == []


LONG = " ".join(["word"] * 60)


@pytest.mark.parametrize("element", [
    '<div class="content with-sidebar">', '<div id="main" class="col no-comments">',
    '<div class="article-body share-enabled">', '<section class="search-results-page article">', "<form>",
])
def test_names_of_the_whole_page_say_nothing(element):
    tree = html_text.grow(*html_text.labelled_blocks())
    page = f"<nav><a href=x>Home</a></nav>{element}<h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p>"
    assert html_text.main_text(page + "</div></section></form><footer>Imprint here</footer>", tree) == (
        f"Title of it\n\n{LONG}\n\n{LONG}"
    )


def test_neighbours_decide_without_tags():
    tree = html_text.grow(*html_text.labelled_blocks())
    among = lambda *texts: html_text.main_text("".join(f"<div>{t}</div>" for t in texts), tree)
    link = "<a href=x>More here</a>"
    assert "few words only" in among("<h2>Some title</h2>", LONG, "few words only", LONG, link)
    assert "few words only" not in among(link, link, "few words only", link, link)
    assert among("Menu one two three four", LONG, LONG) == f"{LONG}\n\n{LONG}"
    used = {k for k, *_ in nodes(tree)}
    assert used & set(range(2, 11))


def nodes(tree):
    if len(tree) > 1:
        yield tree
        yield from nodes(tree[2])
        yield from nodes(tree[3])


def test_deep_pages_in_linear_time():
    start = time.perf_counter()
    html_text.blocks_of("<div>" * 100_000 + "</b>" * 100_000 + "<p class=ad>x" * 20_000)
    assert time.perf_counter() - start < 20


def test_tree_learns_its_table():
    x, y = html_text.labelled_blocks()
    tree = html_text.grow(x, y)
    assert np.mean([html_text.is_text(tree, list(a)) == b for a, b in zip(x, y)]) > 0.95


MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a ", " a", "a  b", "\n\n x\ty", "<s> </s> <unk> <0x41>", "日本語 😀 é",
       "▁ ▁▁a b▁c", "   lead", "x\x00y", "tail   ", "l’été — naïve ﬁ", "Ein Satz. " * 50]


def test_pieces_like_sentencepiece(make):
    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(ODD), (100, None), (100, "again")]
    got = pieces.piece_tokens(make(rows, extra=True), MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 100:
            continue
        ids = other.encode(ODD[r.doc_id])
        assert r.ids == ids and r.parity
        assert r.round_trip == (other.decode(ids) == ODD[r.doc_id])
        assert r.n_chars == len(other.decode(ids))
    code = pieces.PieceEncoder(MODEL)
    for text in ODD:
        ids = other.encode(text)
        assert code.tokenizer.encode(text, add_special_tokens=False).ids == ids
        assert code.tokenizer.decode(ids, skip_special_tokens=False) == other.decode(ids)
    assert pieces.piece_tokens(make([]), MODEL).collect() == []


def wire(fields):
    """A protobuf message of (number, value): texts and bytes, floats, whole numbers."""
    out = b""

    def varint(n):
        parts = []
        while n > 127:
            parts.append(n & 127 | 128)
            n >>= 7
        return bytes([*parts, n])

    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def unigram_model(path, byte_fallback, charsmap, trim, prefix, seed=6, step=8):
    """A model file written by hand: letters, parts of words, pieces of every kind.

    Scores are whole eighths, whose sums are exact in single precision too, or any if ``step`` is 0.
    """
    rng = random.Random(seed)
    words = [f"{pieces.MARKER}{w}" for w in "the text other word ein und noch Das ist mississippi".split()]
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 2, len(w) + 1)}
    normal = sorted(set("abcdefghijklmnoprstuwxyD,.!<0x41>") | {pieces.MARKER} | set(rng.sample(sorted(parts), 120)))
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("<sep>", 0.0, 4), ("[x]", 0.0, 4)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    score = lambda: -rng.randrange(2 * step, 14 * step) / step if step else -rng.uniform(2, 14)
    rows += [(w, score(), 1) for w in normal] + [("zzunusedzz", -1.0, 5), ("q", -3.0, 5)]
    trainer = [(3, 1), (4, len(rows)), (35, int(byte_fallback))]
    normaliser = [(2, charsmap)] if charsmap else []
    normaliser += [(3, int(prefix)), (4, int(trim)), (5, 1)]
    message = [(1, wire([(1, w), (2, score), (3, kind)])) for w, score, kind in rows]
    with open(path, "wb") as f:
        f.write(wire([*message, (2, wire(trainer)), (3, wire(normaliser))]))
    return str(path)


UNIGRAM_TEXTS = [
    "", " ", "the text", "  the  other   word ", "a<sep>b [x][x]c <sep>", "zzunusedzz q", "<s> </s> <unk>",
    "<0x41> A <0x00>", "mississippi " * 300, "日本 é ü\x00 e\u0301 Das", "ｆｕｌｌ ﬁ ½ ①\u3000x\ty\nz", "thetextqq日otherword",
]


@pytest.mark.parametrize("trim,prefix", [(True, True), (False, True), (True, False)])
@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_like_sentencepiece(tmp_path, byte_fallback, mapped, trim, prefix):
    charsmap = b""
    if mapped:
        rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        charsmap = pieces.parse_model(rule).charsmap
        assert charsmap
    path = unigram_model(tmp_path / "u.model", byte_fallback, charsmap, trim, prefix)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    code = pieces.PieceEncoder(path, verify=True)
    rng = random.Random(1)
    texts = UNIGRAM_TEXTS + ["".join(rng.choices("the xo<sep>qwü,. 日", k=rng.randrange(60))) for _ in range(400)]
    coded, same = code.encode([t.encode() for t in texts])
    for text, ids, equal in zip(texts, coded, same):
        want = other.encode(text)
        assert np.frombuffer(ids, code.dtype).tolist() == want, text
        assert equal and code.decode(ids).decode() == other.decode(want), text


def test_unigram_ties_are_told_by_parity(tmp_path):
    """sentencepiece sums in single precision: ways of equal score may differ, and parity says so."""
    path = unigram_model(tmp_path / "u.model", True, b"", True, True, step=0)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    code = pieces.PieceEncoder(path, verify=True)
    rng = random.Random(1)
    texts = ["".join(rng.choices("the xopw,. ", k=rng.randrange(60))) for _ in range(600)]
    coded, same = code.encode([t.encode() for t in texts])
    ids = [np.frombuffer(i, code.dtype).tolist() for i in coded]
    assert same == [a == other.encode(t) for a, t in zip(ids, texts)] and sum(same) > 550
    total = lambda seq: sum(other.get_score(int(i)) for i in seq)
    for a, t in zip(ids, texts):
        assert total(a) == pytest.approx(total(other.encode(t)), abs=1e-4)


def test_unigram_query_rows(make, tmp_path):
    path = unigram_model(tmp_path / "u.model", True, b"", True, True)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.piece_tokens(make([*enumerate(UNIGRAM_TEXTS), (99, None)]), path).collect()
    assert len(got) == len(UNIGRAM_TEXTS) + 1
    for r in got:
        assert r.parity and r.ids == other.encode("" if r.doc_id == 99 else UNIGRAM_TEXTS[r.doc_id])


def test_pieces_that_cannot_be_kept_whole_are_refused(tmp_path):
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    model = pieces.PieceModel([("<unk>", 0.0, 2), ("ﬁ", 0.0, 4), ("a", -1.0, 1)])
    model.charsmap = pieces.parse_model(rule).charsmap
    with pytest.raises(ValueError, match="character map"):
        pieces.build_tokenizer(model)
    model = pieces.PieceModel([("<unk>", 0.0, 2), ("<sep>", 0.0, 4), ("a", -1.0, 1)], kind=pieces.BPE)
    with pytest.raises(ValueError, match="user-defined"):
        pieces.build_tokenizer(model)


def plain_segments(scores):
    """Maximal segments by their definition: the best first, then on both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = [
        (sum(scores[i:j]), -(j - i), i, j)
        for i in range(len(scores))
        for j in range(i + 1, len(scores) + 1)
    ]
    best, _, i, j = max(sums, key=lambda s: (round(s[0], 9), s[1]))
    rest = plain_segments(scores[:i])
    return rest + [(i, j, best)] + [(i2 + j, j2 + j, s) for i2, j2, s in plain_segments(scores[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.integers(-40, 41, rng.integers(0, 14)) + rng.random() / 7
        got = toxicity.maximal_segments(np.array(scores, dtype=float))
        want = plain_segments([float(s) for s in scores])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_of_very_long_texts():
    """Text that drifts down, and one whose every candidate begins lower: time goes with length."""
    n = 400_000
    down = np.tile([1.0, -2.0], n // 2)
    start = time.perf_counter()
    assert len(toxicity.maximal_segments(down)) == n // 2
    stairs = np.tile([1.0, -2.0, 3.0, -4.0, 1.0], n // 5)
    got = toxicity.maximal_segments(stairs)
    assert time.perf_counter() - start < 20
    assert got[:50] == toxicity.maximal_segments(stairs[: 5 * 200])[:50]


def labelled(spark, n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic, poor = int(k % 5 == 0), int(k % 7 == 0)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(("vile", "nasty,", "Foul")) for _ in range(3)]
        text = " ".join(words)
        docs.append((k, text.upper().replace(" ", "$$$ ") if poor else text))
        labels.append((k, 1 - poor, toxic))
    docs += [(n, None), (n + 1, ""), (None, "vile nasty foul vile"), (3, "w1 w2 w3")]
    labels += [(None, 1, 1), (n, None, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, make):
    rows, labels = labelled(spark)
    docs = make(rows, extra=True)
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id not in (400, 401)
             and (r.score >= 0.5) != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 8
    assert all(r.score < 0.5 for r in got if r.doc_id in (400, 401))
    passages = toxicity.toxic_passages(docs, model).where("doc_id = 25").collect()
    assert any("vile" in p.passage.lower() or "nasty" in p.passage.lower()
               or "foul" in p.passage.lower() for p in passages)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < 0.5 for r in got)
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, nothing).collect())


def test_quality(spark, make):
    rows, labels = labelled(spark)
    docs = make(rows, extra=True)
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows)
    wrong = [r.doc_id for r in got if r.doc_id is not None and 3 < r.doc_id < 400
             and (r.score >= 0.7) != (r.doc_id % 7 != 0)]
    assert len(wrong) <= 8
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.7 for r in got)
    assert quality.score_quality(make([]), model).collect() == []
    assert quality.fit_quality(docs, labels.limit(0)).score(b"x", Memo(lambda w: 0.0)) == 0.5


def test_document_logit_is_the_mean_of_words():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=quality.BUCKETS), 0.3)
    text = b"some words words here"
    ids, weights = quality.document_buckets(text, Memo(quality.subwords))
    logit = 0.3 + float(model.logits[ids] @ np.array(weights))
    assert abs(model.score(text, model.scorer()) - 1 / (1 + np.exp(-logit))) < 1e-12
    assert abs(sum(weights) - 1) < 1e-9


def test_join_like_sql_with_long_lists(spark):
    """A family of 200 near copies, in lists far longer than are merged, and copies of it."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for k in range(200):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{k}"
        rows.append((k * 2, " ".join(words)))
    rows += [(1001 + k, rows[k % 5][1]) for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(2001 + k, passage + " " + " ".join(f"u{k}x{i}" for i in range(60))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    names = "doc_id, n_shingles, component_id"
    want = sorted(db.sql(f"SELECT {names} FROM ({OP8})").fetchall())
    got = sorted(tuple(r) for r in ngram_join.ngram_components(docs).select(*names.split(", ")).collect())
    assert got == want and len({c for *_, c in got}) > 60
