"""Text operators: exact round trips, brute force and small fixtures."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoraster.llm import chunkcode, encode, forms, lookalike, mixture

WHOLE = chunkcode.tokenizer().encode_ordinary


def by_chunks(texts, enc=None):
    import pyarrow as pa

    ids, n = (enc or chunkcode.ChunkEncoder()).column(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


ALPHABET = " \n\r\t\x0b\x1c  　\u0085'sdlvretm0123٣½²,.:->!<|éАя中。ﬁ́\U0001f3ac、「」！？，本はとカ\u30fb\u30a0゛ー々〇\u3099" + "ab"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), max_size=6))
def test_chunked_ids_equal_whole_text_ids(texts):
    assert by_chunks(texts) == [WHOLE(t) for t in texts]


def test_long_special_and_empty_texts(monkeypatch):
    rnd = random.Random(0)
    words = ["the ", "l'été ", "00:12:03,44", "\n\n", " <|endoftext|>", "река", "本はとても", "don't", "  "]
    long = "".join(rnd.choice(words) for _ in range(30000))
    texts = [None, "", " ", long, "x" * 5000, "", long[:777], "<|endoftext|>"]
    want = [WHOLE(t or "") for t in texts]
    assert by_chunks(texts) == want
    monkeypatch.setattr(chunkcode, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(chunkcode, "CHUNK_CACHE", 3000)
    monkeypatch.setattr(chunkcode, "WORD_CACHE", 3000)
    assert by_chunks(texts) == want
    monkeypatch.setattr(chunkcode, "LONGEST_KEPT", 4)
    assert by_chunks(texts) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=120), max_size=6))
def test_short_chunks_are_joined_exactly(texts):
    """Chunk ends at every second position and a window of three bytes: nearly all joins are encoded again."""
    old = chunkcode.WINDOW, chunkcode.ONE_IN
    chunkcode.WINDOW, chunkcode.ONE_IN = 3, 2
    try:
        assert by_chunks(texts) == [WHOLE(t) for t in texts]
    finally:
        chunkcode.WINDOW, chunkcode.ONE_IN = old


def test_chunks_are_passages_and_the_caches_stay_within_bounds(monkeypatch):
    rnd = random.Random(3)
    han = "".join(map(chr, range(0x5000, 0x5400)))
    passages = ["".join(rnd.choice(han) for _ in range(1500)) + "。" for _ in range(60)]
    texts = [passages[i % 60] + str(i) + passages[(i * 7) % 60] for i in range(200)]
    monkeypatch.setattr(chunkcode, "CHUNK_CACHE", 1 << 20)
    monkeypatch.setattr(chunkcode, "WORD_CACHE", 1 << 20)
    enc = chunkcode.ChunkEncoder()
    assert by_chunks(texts, enc) == [WHOLE(t) for t in texts]
    for cache in (enc.chunks, enc.words):
        assert sum(len(k) + v.nbytes for k, v in cache.ids.items()) <= 1 << 20
    assert enc.reused > enc.encoded
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    enc = chunkcode.ChunkEncoder()
    by_chunks([" ".join(rnd.choice(words) for _ in range(20000))], enc)
    long = [len(k) for k in enc.chunks.ids if len(k) > 20]
    assert 150 < np.mean(long) < 1000


def test_equal_hashes_do_not_mix_pieces(monkeypatch):
    monkeypatch.setattr(chunkcode, "_MIX", np.uint64(0))
    monkeypatch.setattr(chunkcode, "_prefix", lambda data, up: np.zeros(len(data) + 1, np.uint64))
    texts = ["ab cd 12,34 ef", "xy zz 99,11 qq", "ab cd"]
    assert by_chunks(texts) == [WHOLE(t) for t in texts]


def test_pieces_are_reused():
    enc = chunkcode.ChunkEncoder()
    by_chunks(["one two three, 4 five\n"] * 50, enc)
    assert enc.reused > 10 * enc.encoded > 0


def test_encode_corpus(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, " "), (None, "x"), (1, "Hello there")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' as ids", "1 as k", "2 as n_tokens", "'q' as state")
    got = sorted((r.doc_id or 0, r.ids, r.n_tokens, r.state) for r in encode.encode_corpus(df).collect())
    assert got == sorted((i or 0, WHOLE(t or ""), len(WHOLE(t or "")), "null" if t is None else "text" if t else "empty") for i, t in rows)
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_tokenizer_libraries_agree():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(chunkcode.DEFAULT_DIR + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["It's 5.\n\nЭто мост <|endoftext|> ", "  a b　", "½²3"]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == by_chunks(texts)


# ---- look-alikes

SAME = [
    ("café", "café"), ("Ｈｉ　there", "Hi there"), ("ﬁne", "fine"), ("a b", "a b"), ("ab​c", "abc"), ("so­ft", "soft"),
    ("non‑stop", "non-stop"), ("сосо", "coco"), ("Pаul", "Paul"), ("й", "й"), ("ガ", "ガ"), ("ｶﾞ", "ガ"), ("Κάτι", "Kάτι"), ("K", "K"),
    ("ГПФ", "ΓΠΦ"), ("к", "κ"), ("ⅼ", "l"), ("Ⅳ", "IV"), ("ᴏ", "o"), ("ⲟ", "o"), ("ꓐ", "B"), ("cσffee", "coffee"), ("ɡo", "go"), ("æ", "ӕ"),
]
OTHER = [("A", "a"), ("cafe", "café"), ("1", "l"), ("0", "O"), ("a b", "a\nb"), ("a\r\nb", "a\nb"), ("x²", "x2"), ("ab", "a b"), ("б", "6"), ("...", "…"), ("ırak", "irak"), ("σο", "οο"), ("סב", "oב"), ("кот", "kот")]


@pytest.mark.parametrize("a,b", SAME)
def test_forms_of_look_alikes_are_equal(a, b):
    for before, after in (("", ""), ("Это мост ", " и река"), ("the ", " end"), ("και το ", " σπίτι")):
        assert lookalike.consistent_form(before + a + after) == lookalike.consistent_form(before + b + after)


@pytest.mark.parametrize("a,b", OTHER)
def test_forms_of_others_differ(a, b):
    assert lookalike.consistent_form(a) != lookalike.consistent_form(b)


def test_spelling_takes_the_tokens_script():
    assert lookalike.consistent_form("Это мoст") == "Это мост"  # Latin o
    assert lookalike.consistent_form("Это сосо здесь") == lookalike.consistent_form("Это coco здесь") == "Это сосо здесь"
    assert lookalike.consistent_form("the сосо") == "the coco"
    assert lookalike.resolved_scripts("coco") >= {"Latin", "Cyrillic"} and not lookalike.resolved_scripts("zж")
    assert lookalike.mixed_tokens("Pаul сосо мост") == (1, 1)
    assert lookalike.mixed_tokens("abא aж ab漢 abع 日本の 한글字 être") == (4, 0)


def test_script_resolution_decides_forms(monkeypatch):
    """What the skeletons alone leave apart, the intersection of script sets brings together, and only in mixed tokens."""
    a, b = "cσffee", "coffee"
    assert lookalike.skeleton(a) != lookalike.skeleton(b) and lookalike.consistent_form(a) == lookalike.consistent_form(b)
    assert lookalike.consistent_form("σοφός") == "σοφός"


def test_recall_and_precision_on_generated_look_alikes():
    """Letters swapped for others of the Unicode security data, over five scripts; and words that must stay apart."""
    from chronoraster.llm import confusables

    proto = confusables.prototypes()
    if not proto:
        pytest.skip("no confusables here")
    by = {}
    for c, p in proto.items():
        if confusables.kind(c, p) in ("u", "l") and len(p) == 1 and unicodedata.normalize("NFKD", c) == c:
            by.setdefault((p, confusables.kind(c, p)), []).append(c)
    words = "coffee people history answer ΚΑΛΗΜΕΡΑ ουρανος привет соседка хорошо ВОСТОК příklad gość mañana Straße ἀγορά Երևան".split()
    rnd, hit, tries = random.Random(4), 0, 0
    for _ in range(1500):
        w = rnd.choice(words)
        i = rnd.randrange(len(w))
        others = [c for c in by.get((proto.get(w[i], w[i]), "u" if w[i].isupper() else "l"), []) if c != w[i]]
        if not others:
            continue
        tries += 1
        hit += lookalike.consistent_form(w[:i] + rnd.choice(others) + w[i + 1 :]) == lookalike.consistent_form(w)
    assert tries > 500 and hit / tries >= 0.9, hit / tries
    forms_ = [lookalike.consistent_form(w) for w in words]
    assert len(set(forms_)) == len(words)
    # within one script nothing is lost: all pairs of letters of a kind stay apart
    for name in ("CYRILLIC", "GREEK", "LATIN"):
        letters = [chr(c) for c in range(0x41, 0x500) if unicodedata.name(chr(c), "").startswith(f"{name} SMALL LETTER") and unicodedata.normalize("NFKD", chr(c)) == chr(c)]
        seen = {}
        for c in letters:
            seen.setdefault(lookalike.consistent_form(c), []).append(c)
        assert sum(len(x) - 1 for x in seen.values()) <= 0.05 * len(letters), seen


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aоeсHКxiıΑνσfé́ \n​ﬁＡйжßŉ-‐1lא漢", max_size=30))
def test_form_is_stable(text):
    f = lookalike.consistent_form(text)
    assert lookalike.consistent_form(f) == f
    assert unicodedata.normalize("NFC", f) == f


def test_pairs(spark, monkeypatch):
    rows = [(1, "Pаul"), (2, "Paul"), (3, "Paul"), (4, "paul"), (5, " "), (6, "　"), (7, None), (8, None), (9, ""), (10, "P​aul"), (11, "Pаul"), (None, "Paul"), (12, "​"), (13, "\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as form_key", "2 as k", "3 as text_key", "4 as first")
    got = {tuple(r) for r in forms.lookalike_pairs(df).collect()}
    texts = [{1, 11}, {2, 3}, {10}]
    every = {(min(a, b), max(a, b)) for s in texts for t in texts if s is not t for a in s for b in t}
    assert got == every
    classes = {r.doc_id: r for r in forms.lookalike_classes(df).collect()}
    ids = sorted(classes)
    assert ids == [1, 2, 3, 4, 10, 11] and classes[3].n_texts == 3 and classes[3].n_docs == 5
    assert {(a, b) for a in ids for b in ids if a < b and classes[a].class_id == classes[b].class_id and classes[a].text_id != classes[b].text_id} == every
    assert forms.lookalike_pairs(df.limit(0)).count() == 0 and forms.lookalike_classes(df.limit(0)).count() == 0
    monkeypatch.setattr(forms, "FULL", 4)  # five documents: the first documents of each text stand for it
    assert {tuple(r) for r in forms.lookalike_pairs(df).collect()} == every - {(3, 11)}
    monkeypatch.setattr(forms, "FULL", 64)
    hot = spark.range(2000).selectExpr("id as doc_id", "case when id = 1999 then 'Pаul' else 'Paul' end as text")
    assert forms.lookalike_pairs(hot).count() == 1999


def test_many_variants_stay_linear(spark):
    """1,000 copies of one text, each with a zero-width character somewhere else."""
    many = spark.range(1000).selectExpr("id as doc_id", "concat(repeat('ab ', cast(id as int) % 500), '​', repeat('ab ', 500 - cast(id as int) % 500)) as text")
    assert forms.lookalike_pairs(many).count() <= 1000 * 64
    assert forms.lookalike_classes(many).select("class_id").distinct().count() == 1


# ---- mixing


def brute(lengths, budget):
    items = [n for n, c in lengths.items() for _ in range(c)]
    sums = {0}
    for n in items:
        sums |= {s + n for s in sums if s + n <= budget}
    return max(sums)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 6), max_size=6), st.integers(0, 300))
def test_budget_is_fitted_exactly(lengths, budget):
    got, proven = mixture.fit_budget(lengths, budget)
    assert proven and all(c <= lengths[n] for n, c in got.items())
    assert sum(n * c for n, c in got.items()) == brute({n: c for n, c in lengths.items() if n}, budget)


def test_budget_of_few_long_documents_is_fitted_exactly():
    for lengths, budget, best in (({60000: 1, 50000: 1, 40000: 1}, 90000, 90000), ({60001: 2, 50000: 3}, 111000, 110001), ({997: 40, 1009: 3}, 20001, None)):
        got, proven = mixture.fit_budget(lengths, budget)
        assert proven and sum(n * c for n, c in got.items()) == (best or brute(lengths, budget))


def test_what_is_not_proven_is_said():
    lengths = {60001: 400, 50003: 700}
    got, proven = mixture.fit_budget(lengths, 12_345_678, work=1)
    reached = sum(n * c for n, c in got.items())
    assert not proven and 12_345_678 - 50003 < reached <= 12_345_678 and all(c <= lengths[n] for n, c in got.items())


def test_large_budget_is_met():
    rnd = random.Random(1)
    lengths = {n: rnd.randint(1, 200_000) for n in rnd.sample(range(20, 20_000), 3000)}
    total = sum(n * c for n, c in lengths.items())
    got, proven = mixture.fit_budget(lengths, total // 3)
    assert proven and sum(n * c for n, c in got.items()) == total // 3 and all(c <= lengths[n] for n, c in got.items())


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_mixture(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixture, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(mixture, "BROADCAST_ROWS", broadcast)
    rows = [(i, "word " * (1 + i % 5), " Big" if i % 2 else "big") for i in range(300)]
    rows += [(1000 + i, "word " * 9, "SMALL ") for i in range(4)] + [(2000, "x", "unlisted"), (2001, None, "big"), (2002, "", "small"), (2003, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as n_tokens", "2 as source_key", "3 as pos")
    target = spark.createDataFrame([("Big", 0.6, 1), ("small", 0.3, 2), ("gone", 0.1, 5)], "source string, target_share double, max_repeat int")
    m = mixture.measure(docs, target)
    by = {s.source: s for s in m.sources}
    report = {r.source: r for r in mixture.shares(m).collect()}
    total = by["Big"].tokens + by["small"].tokens
    assert by["small"].short and by["gone"].short and not by["Big"].short
    assert report["Big"].chosen_tokens == int(0.6 * total) and report["small"].chosen_tokens == 2 * by["small"].tokens
    assert all(r.proven for r in report.values()) and 0 <= report["Big"].missed_tokens < 1
    out = mixture.select(m).collect()
    assert len({r.doc_id for r in out}) == len(out) and all(r.n_uses <= by[r.source].cap for r in out)
    for s in ("Big", "small"):
        assert sum(r.n_tokens * r.n_uses for r in out if r.source == s) == report[s].chosen_tokens
    assert {r.doc_id for r in out} == {r.doc_id for r in mixture.select(m).collect()}
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        mixture.measure(docs, target.union(target))
    empty = mixture.measure(docs.limit(0), target)
    assert mixture.select(empty).count() == 0 and mixture.shares(empty).where("short").count() == 0
    assert mixture.measure(docs, target.limit(0)).sources == []


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {"p6_found", "p6_ids", "p7_found", "p8_found"} <= set(e.queries())
