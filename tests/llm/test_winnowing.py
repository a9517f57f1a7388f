import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import winnowing
from millrace.llm.winnowing import K, W, code_points, gram_hashes, winnow


def slow_hash(gram):
    """The polynomial of one gram, term by term."""
    mask = 2**64 - 1
    base, h = 0xD1B54A32D192ED03, 0
    for i, c in enumerate(gram):
        h = (h + (ord(c) + 1) * 0x9E3779B97F4A7C15 * pow(base, i, 2**64)) & mask
    for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * mult) & mask
    return (h ^ (h >> 33)) >> 32


def brute(text, k, w):
    """(hash, position) of each window's smallest hash, the rightmost of equals."""
    k = min(k, len(text))
    h = [slow_hash(text[i : i + k]) for i in range(len(text) - k + 1)] if text else []
    w, picked = min(w, len(h)), []
    for i in range(len(h) - w + 1 if h else 0):
        at = max(j for j in range(i, i + w) if h[j] == min(h[i : i + w]))
        if (h[at], at) not in picked:
            picked.append((h[at], at))
    return picked


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abé日", max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_selection(text, k, w):
    h, at = winnow(code_points(text), k, w)
    assert list(zip(h.tolist(), at.tolist())) == brute(text, k, w)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30), st.text("abcdefg", min_size=13, max_size=20))
def test_guarantee(left, right, shared):
    """A shared run of w + k - 1 code points is found."""
    a, b = winnow(code_points(left + shared), 5, 9)[0], winnow(code_points(shared + right), 5, 9)[0]
    assert len(np.intersect1d(a, b))


def test_rolling_hash_depends_on_content_only():
    a, b = gram_hashes(code_points("xxabcdefyy"), 6), gram_hashes(code_points("abcdef"), 6)
    assert b[0] in a.tolist()


def check(frame, rows, **options):
    got = winnowing.edit_trial(frame(rows), **options).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for n, (i, t) in enumerate(order):
        t, y = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + y[:q]
        a, b, c = (known(x) for x in (t, e, y))
        digits = lambda p: "".join(f"{h:08x}" for h in sorted({h for h, _ in p}))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), digits(a), digits(b), jaccard(a, b), jaccard(a, c), [x for _, x in a], [x for _, x in b]))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.longest_shared >= r.n_chars - r.n_chars // 4 or r.n_chars - r.n_chars // 4 < K + W - 1


def known(text):
    """brute(), or winnow() for texts that would take it too long: test_selection holds that against it."""
    if len(text) <= 3000:
        return brute(text, K, W)
    h, at = winnow(code_points(text))
    return list(zip(h.tolist(), at.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.text("abcdefg", min_size=13, max_size=40), st.text("xy", max_size=12), st.text("xy", max_size=12))
def test_longest_shared(a, b, shared, c, d):
    x, y = code_points(a + shared + b), code_points(c + shared + d)
    got = winnowing.longest_shared(x, winnow(x, 5, 9), y, winnow(y, 5, 9), 5)
    s, t = a + shared + b, c + shared + d
    most = max(n for n in range(len(s) + 1) for i in range(len(s) - n + 1) if s[i : i + n] in t)
    assert 0 < got <= most


ROWS = [(i * 7 % 101, ("word%d é日 " % (i % 13)) * (i * 5 % 60)) for i in range(60)]


def test_matches_brute_force(frame):
    for chunk_bytes in (500, 10**8):
        check(frame, ROWS, chunk_bytes=chunk_bytes)


def test_edges(frame):
    check(frame, [(1, None), (2, ""), (3, "ab"), (3, "ab"), (3, "abcdefgh"), (None, "null id text"), (None, None), (4, "long text " * 30000)], chunk_bytes=50)
    check(frame, [(5, "single row of text")])
    check(frame, [(None, "x y z"), (None, "a b c")], chunk_bytes=5)
    assert winnowing.edit_trial(frame([])).collect() == []


def test_positions_are_kept(frame):
    row = winnowing.fingerprints(frame([(1, "some text that is long enough to have several windows in it, surely")])).first()
    h, at = winnow(code_points(row.text))
    assert [(x.hash, x.position) for x in row.winnowed] == list(zip(h.tolist(), at.tolist()))
