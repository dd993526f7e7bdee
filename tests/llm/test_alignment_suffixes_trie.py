"""Operators 11 to 13 against brute force on small tables with nulls, empty, long and repeated rows, and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenqa.llm import prefix_trie, suffix_dedup, token_alignment, words

DOCS = "doc_id long, text string, row long, pair int, size string, k1 string, number int, core long, n_a string"


def docs(spark, rows):
    """The other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, 7, 8, "x", "y", 3, 4, "z") for i, t in rows], DOCS)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# 11

TEXTS = [
    "The cat sat on the mat.", "", None, " leading and  double  spaces ", "tab\tand\nline\n\n breaks \n", "naïve café — “quoted” 12,345.67 it's we'll",
    "<|endoftext|> and </s> are plain", "under▁score mark", "日本語 のテキスト 🙂 emoji", "a b  c ​d", "x" * 3000, "word " * 500, "The cat sat on the mat.", "\x00control \x1f here \x85 next", "…  … é ﬁ", "   ", "a",
]


@pytest.fixture(scope="module")
def whole_text():
    """Both tokenizers on whole texts, by their own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(token_alignment.LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=token_alignment.RIGHT)
    entries = {i: x for x, i in token_alignment.left_vocabulary().items()}
    pieces = token_alignment.right_pieces(right)

    def tokens(text):
        if not text:
            return [], []
        a = left.encode(" " + text, add_special_tokens=False).ids
        b = right.encode(text)
        x, y = [entries[i] for i in a], [pieces[i] for i in b]
        want = (" " + text).encode()
        return (list(zip(a, x)), list(zip(b, y))) if b"".join(x) == want == b"".join(y) else ([], [])

    return tokens


def brute_links(a, b):
    """Overlapping token occurrences and groups, from byte ranges alone."""
    ranges = lambda side: [(i, sum(len(x) for _, x in side[:k]), sum(len(x) for _, x in side[: k + 1])) for k, (i, _) in enumerate(side)]
    x, y = ranges(a), ranges(b)
    links = [(i, j) for i, p, q in x for j, r, s in y if p < s and r < q]
    both = sorted({q for *_, q in x} & {s for *_, s in y})
    groups, low = [], 0
    for end in both:
        inside = lambda side: ",".join(str(i) for i, p, q in side if low <= p and q <= end)
        groups.append(f"{inside(x)}|{inside(y)}")
        low = end
    return links, groups


def brute_alignment(rows, tokens):
    per = [(i, *(sides := tokens(t)), *(brute_links(*sides) if sides[0] else ([], []))) for i, t in rows]
    counts = Counter(p for *_, links, _ in per for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, a, b, links, groups in per
    ]


@pytest.mark.parametrize("sent", [token_alignment.MAX_SENT_PAIRS, 0])
def test_alignment(spark, whole_text, sent):
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(TEXTS)]
    got = token_alignment.align_tokens(docs(spark, rows), sent_pairs=sent)
    assert key(got.collect()) == key(brute_alignment(rows, whole_text))
    assert token_alignment.align_tokens(docs(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "a", "the", "'ll", "\n", "é", "▂", "1", "99", ".", "\t", " ", "日", "Ünd", "́", "\x85", "🙂"]), max_size=20))
def test_segments_are_the_whole(whole_text, parts):
    """Encoding segment by segment gives the tokens of the whole text, with any slicing and memory."""
    text = "".join(parts)
    a, b = whole_text(text)
    links, groups = brute_links(a, b) if a else ([], [])
    got = _aligner().align(text)
    assert got[:4] == (len(a), len(b), len(groups), len(links))
    assert got[4] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    want = Counter(x * token_alignment.WIDTH + y for x, y in links)
    assert dict(zip(got[5].tolist(), got[6].tolist())) == want


_one = []


def _aligner():
    if not _one:
        _one.append(token_alignment.Aligner(remembered=30))
    return _one[0]


def test_long_text_in_slices(monkeypatch):
    random.seed(4)
    text = " ".join(random.choice(["alpha", "béta", "gamma,", "\n\ndelta", "x y"]) for _ in range(5000))
    whole = token_alignment.Aligner().align(text)
    monkeypatch.setattr(token_alignment.slices, "__defaults__", (100,))
    assert len(list(token_alignment.slices(text))) > 100
    sliced, together = token_alignment.Aligner(), token_alignment.Aligner(remembered=50)
    for got in (sliced.align(text), *together.align_all([text, None, "short one", text])):
        if got[0] > 10:
            assert all(np.array_equal(x, y) for x, y in zip(got, whole))


# 12


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if counts[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def pieces_of_text(seed, n, alphabet="abé "):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(8, 90))) for _ in range(6)]
    rows = [(None, None), (0, ""), (0, "a"), (1, "ab" * 60), (2, "z" * 300)]
    for i in range(n):
        text = "".join(rng.choice(shared)[rng.randint(0, 9) :] if rng.random() < 0.4 else "".join(rng.choice(alphabet + "xyz") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8)))
        rows.append((i % 17, text))
    return rows + rows[8:12] + [rows[9]]


@pytest.mark.parametrize("length,core,hot,seed,block,run", [(24, 12, 20_000, 1, 1 << 15, 16 << 20), (20, 5, 20_000, 2, 4, 500), (16, 16, 3, 3, 1 << 15, 16 << 20), (30, 10, 0, 4, 1, 2000), (12, 9, 5, 5, 7, 100)])
def test_repeats(spark, monkeypatch, length, core, hot, seed, block, run):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 7)
    monkeypatch.setattr(words, "CHUNK_BYTES", 1 << 7)
    rows = pieces_of_text(seed, 80)
    got = suffix_dedup.remove_repeats(docs(spark, rows), suffix_dedup.SuffixParams(length, core, hot))
    assert key(got.collect()) == key(brute_repeats(rows, length))


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    got = suffix_dedup.remove_repeats(docs(spark, [(1, None), (2, "short")])).collect()
    assert key(got) == key(brute_repeats([(1, None), (2, "short")], 200))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=8).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=7))
def test_merge_of_front_coded_runs(runs):
    """The loser tree gives all strings in order, with the length that each shares with the one before."""
    ordered = [sorted(r) for r in runs]
    out = list(suffix_dedup.merge_runs([suffix_dedup.front_code(r) for r in ordered]))
    assert [s for *_, s in out] == sorted(s for r in runs for s in r)
    assert all(ordered[r][i] == s for r, i, _, s in out)
    past = b""
    for _, _, shared, s in out:
        assert shared == suffix_dedup.common_prefix(past, s, 0)
        past = s


def test_known_prefixes_are_not_compared_again(monkeypatch):
    """Bytes looked at while 64 runs of long equal prefixes are merged are fewer than the prefixes hold."""
    rng = random.Random(3)
    runs = [sorted(b"p" * 150 + bytes(rng.choice(b"abc") for _ in range(20)) for _ in range(40)) for _ in range(64)]
    coded, seen = [suffix_dedup.front_code(r) for r in runs], [0]
    plain = suffix_dedup.common_prefix

    def counted(a, b, known):
        n = plain(a, b, known)
        seen[0] += n - known + 1
        return n

    monkeypatch.setattr(suffix_dedup, "common_prefix", counted)
    assert len(list(suffix_dedup.merge_runs(coded))) == 64 * 40
    assert seen[0] < 64 * 40 * 30  # each string's 150 shared bytes are compared once a run at most, not once a comparison


# 13

CONV = "conv_id long, turn long, role string, text string, depth long, node string, h long, size long"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    nodes = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, who in nodes.items():
        words = len([w for w in "".join(x if x not in "\t\n\x0b\x0c\r" else " " for x in k[-1][1]).split(" ") if w]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(who) - 1) * words
    return [
        (min(who), len(k), min(nodes[k[:-1]]) if k else None, len(who), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(who) if len(built[c]) == len(k)).encode()).hexdigest())
        for k, who in nodes.items()
    ]


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], CONV)


@pytest.mark.parametrize("span,ids,seed", [(4096, 4096, 1), (3, 2, 2)])
def test_trie(spark, monkeypatch, span, ids, seed):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody's"), (7, None, None, "first"), (7, 0, "user", None), (7, 0, "user", None), (-3, 1, "user", "below zero"), (-45, 0, "user", "x y"), (61, 0, "user", "no head")]
    for c in [*range(0, 45), 100, 101, 119]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["same  words", "a\tb c", ""])))
    rows += [(c, t, "user", f"turn {t} of many") for c in (140, 141, 142) for t in range(40)]
    got = prefix_trie.prefix_trie(chats(spark, rows))
    assert key(got.collect()) == key(brute_trie(rows))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(chats(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(chats(spark, [(None, 1, "user", "x")])).count() == 0
