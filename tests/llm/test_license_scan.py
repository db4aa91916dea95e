import random

from hypothesis import given, settings
from hypothesis import strategies as st

from duskwatch.llm.license_scan import Automaton, Scanner, scan_documents
from duskwatch.llm.license_texts import TEMPLATES

SMALL = {"A": ["a b c d e f g h"], "B": ["p q r s t u", "a b x"], "C": ["c d e z z"]}


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8), max_size=4), st.lists(st.integers(0, 4), max_size=30))
def test_matching_statistics_against_search(seqs, text):
    a = Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    stat = [max([n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in subs], default=0) for i in range(len(text))]
    want = [(i + 1, n) for i, n in enumerate(stat) if n and (i + 1 == len(text) or stat[i + 1] != n + 1)]
    got = list(a.matches(text))
    assert [(e, n) for e, n, _ in got] == want
    for e, n, s in got:
        places = {(t, i + n) for t, q in enumerate(seqs) for i in range(len(q) - n + 1) if q[i : i + n] == text[e - n : e]}
        assert a.ends[s] == places


def plain(text, templates, least):
    """Maximal matches of a whole text, streamed without the filter on pairs."""
    s = Scanner(templates, min_match=least)
    vocab = {w: i for i, w in enumerate(sorted({x for ts in templates.values() for t in ts for x in t.split()}))}
    hits = [(e, n, q) for e, n, q in s.automaton.matches([vocab.get(w, -1) for w in text.split()]) if n >= 2]
    return s.spans(hits)


def test_filter_on_pairs_changes_nothing():
    rng = random.Random(6)
    words = "a b c d e f g h p q r s t u x z other".split()
    for _ in range(300):
        t = []
        for _ in range(rng.randrange(1, 6)):
            src = rng.choice([v for ts in SMALL.values() for v in ts]).split()
            i = rng.randrange(len(src))
            t += src[i : i + rng.randrange(1, 9)] + [rng.choice(words)] * rng.randrange(3)
        text = " ".join(t)
        got = [r[1:] for r in Scanner(SMALL, min_match=3).scan([text])]
        assert got == plain(text, SMALL, 3), text


def test_every_template_is_found_whole_and_with_changes():
    s = Scanner(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for t in texts:
            got = list(s.scan([f"Some words. {t} More words."]))
            assert [(g[1], g[5]) for g in got] == [(name, 1.0)], t
            if len(t.split()) > 40:
                w = t.split()
                w[20] = "changed"
                assert name in {g[1] for g in s.scan([" ".join(w)])}


def test_clean_text_and_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, "the license of this software is not a template"), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "x\nLicensed under CC BY-NC 4.0."), (5, "word " * 100000 + TEMPLATES["ISC"][0])]
    got = scan_documents(documents(rows, extra="license,coverage,matches")).collect()
    assert sorted((r.doc_id or -1, r.license, r.span_start, r.span_end) for r in got) == [(-1, "CC-BY-NC-4.0", 1, 8), (4, "MIT", 0, 5), (4, "MIT", 0, 5), (5, "ISC", 100000, 100000 + len(TEMPLATES["ISC"][0].replace("/", " ").split()))]
    assert scan_documents(documents([])).count() == 0
    assert scan_documents(documents(rows), templates={}).count() == 0


def test_templates_of_one_token():
    s = Scanner({"U": ["unlicense"], "W": ["wtfpl public license"]})
    assert [g[:5] for g in s.scan(["unlicense", "this: Unlicense, or WTFPL public license", "public unlicense public", "other"])] == [(0, "U", 0, 1, 1), (1, "U", 1, 2, 1), (1, "W", 3, 6, 3), (2, "U", 1, 2, 1)]


def chains_by_search(text, names, templates, min_match, min_cover, max_gap):
    """Spans by exhaustive search: every chain of matches of a template, then the best of those that overlap.

    A chain's links follow each other in text and template with gaps of `max_gap` tokens at most; tokens that two links share count once.
    """
    subs = [{tuple(t[i:j]): None for i in range(len(t)) for j in range(i + 1, len(t) + 1)} for t in templates]
    known = {q for own in subs for q in own}
    stat = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in known), default=0) for i in range(len(text))]
    ends = [(i + 1, n) for i, n in enumerate(stat) if n and (i + 1 == len(text) or stat[i + 1] != n + 1)]
    chains = []
    for t, q in enumerate(templates):
        ms = sorted((e - n, p, n) for e, n in ends if n >= min(min_match, len(q)) for p in range(len(q) - n + 1) if q[p : p + n] == text[e - n : e])

        def grow(chain, covered, q=q, ms=ms, t=t):
            if covered >= min_cover * len(q):
                chains.append((-covered, len(q), t, chain[0][0], chain[-1][0] + chain[-1][2]))
            d0, p0, n0 = chain[-1]
            for d, p, n in ms:
                lap = max(0, d0 + n0 - d, p0 + n0 - p)
                if d > d0 and p > p0 and lap < min(n, n0 + n) and lap < n and d - d0 - n0 <= max_gap and p - p0 - n0 <= max_gap:
                    grow([*chain, (d, p, n)], covered + n - lap)

        for m in ms:
            grow([m], m[2])
    return chains


def test_chains_cover_as_much_as_the_best_by_exhaustive_search():
    """Of each text the most covered chain of all, its template and coverage: no chain by search covers more, and the spans found are chains by search."""
    rng = random.Random(9)
    templates = {"A": ["a b c d e f g h i j"], "B": ["p q r s t u v"]}
    seqs = [t[0].split() for t in templates.values()]
    found = 0
    for _ in range(400):
        text = []
        for _ in range(rng.randrange(1, 5)):
            src = rng.choice(seqs)
            i = rng.randrange(len(src))
            text += src[i : i + rng.randrange(2, 8)] + ["other"] * rng.randrange(3)
        got = [r[1:] for r in Scanner(templates, min_match=2, min_cover=0.5, max_gap=3).scan([" ".join(text)])]
        want = chains_by_search(text, "AB", seqs, 2, 0.5, 3)
        assert bool(got) == bool(want)
        if want:
            found += 1
            best = min(want)
            assert (best[2], -best[0]) in {("AB".index(n), c) for n, _, _, c, _, _ in got}, text
            assert all(("AB".index(n), b, e) in {c[2:] for c in want} for n, b, e, *_ in got)
    assert found > 100
