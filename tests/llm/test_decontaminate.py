import random
import re

from duskwatch.llm import decontaminate as D

Q = "Alice has 12 apples and gives 5 apples to Bob before they walk 3 km to the market. How many apples does Alice have when Bob returns 2 of them?"
ITEMS = [(1, Q), (2, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer again"), (3, "short item here"), (4, "too short"), (5, None), (6, "")]


def other(text, **names):
    for a, b in names.items():
        text = re.sub(rf"\b{a.lstrip('_')}\b", b, text)
    return text


def found(texts, items=ITEMS):
    own = [(i, t) for i, t in items if t]
    return [(r[0], r[1], r[2]) for r in D.find(texts, D.Benchmark([i for i, _ in own], [t for _, t in own]))]


def test_verbatim_whatever_the_case_and_surroundings():
    assert found([f"Before. {Q} After.", Q.upper(), "x " + ITEMS[1][1] + " y", "a short, ITEM here b", "too short"]) == [(0, 1, "verbatim"), (1, 1, "verbatim"), (2, 2, "verbatim"), (3, 3, "verbatim"), (4, 4, "verbatim")]


def test_other_numbers_names_and_units_of_the_same_dimension():
    text = other(Q, Alice="Maria", Bob="Tom", _12="40", _5="7", _2="11", km="miles")
    assert found(["Intro. " + text]) == [(0, 1, "reparameterised")]


def test_inconsistent_slots_are_no_match():
    text = Q.replace("Alice has", "Maria has").replace("to Bob", "to Tom").replace("does Alice", "does Kim").replace("when Bob", "when Lee").replace("3 km", "3 kg").replace("12", "5")
    assert found(["Intro. " + text]) == []


def test_clean_texts_stay():
    rng = random.Random(2)
    words = Q.lower().split()
    assert found([" ".join(rng.choice(words) for _ in range(300)) for _ in range(20)] + [Q[: len(Q) // 3], "", None]) == []


def test_numbers_and_runs_of_names_are_one_slot():
    f = D.forms(["We paid 1,250.50 dollars to John Smith Jones in 3km2 today"])
    assert [f.value(i).decode() for i in range(len(f.kind)) if f.kind[i] != D.WORD] == ["1,250.50", "dollars", "john smith jones", "3", "km", "2"]
    assert [int(k) for k in f.kind if k] == [D.NUM, D.UNIT, D.NAME, D.NUM, D.UNIT, D.NUM]


def brute_windows(text, items, k=8):
    """Verbatim coverage by plain search."""
    tok = lambda s: re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+", s.lower())
    w, out = tok(text), set()
    for i, t in items:
        v = tok(t)
        n = min(k, len(v))
        if n < 3:
            continue
        have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        covered = {p + j for p in range(len(v) - n + 1) if tuple(v[p : p + n]) in have for j in range(n)}
        if len(covered) >= 0.5 * len(v):
            out.add(i)
    return out


def test_against_plain_search():
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "ee", "io")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40)))) for i in range(15)]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(60)]
        v = rng.choice(items)[1].split()
        a = rng.randrange(len(v))
        w[20:20] = v[a : a + rng.randrange(len(v) + 1)]
        texts.append(" ".join(w))
    got = {}
    for d, i, _ in found(texts, items):
        got.setdefault(d, set()).add(i)
    for d, t in enumerate(texts):
        assert got.get(d, set()) == brute_windows(t, items), d


def test_tables(spark, documents):
    bench = spark.createDataFrame([*ITEMS, (None, "some null id item text of more than eight words here"), (2, "aa")], "item_id long, text string")
    rows = [(1, "Then " + Q), (1, "Then " + Q), (None, Q), (2, None), (3, ""), (4, "clean"), (5, other(Q, Alice="Eve", Bob="Ann", _12="13"))]
    df = documents(rows, extra="item_id,kind,coverage")
    for part in (100, 1):
        got = sorted((r.doc_id or -1, r.item_id, r.kind) for r in D.contaminated(df, bench, part_items=part).collect())
        assert got == [(-1, 1, "verbatim"), (1, 1, "verbatim"), (1, 1, "verbatim"), (5, 1, "reparameterised")]
        kept = D.clean(df, bench, part_items=part)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(df, none).count() == 0 and D.clean(df, none).count() == len(rows)
    assert D.contaminated(documents([]), bench).count() == 0


def test_long_text(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, "filler words here " * 100000 + Q)]
    assert [r.item_id for r in D.contaminated(documents(rows), bench).collect()] == [1]


def test_every_text_of_an_id_and_items_without_one(spark, documents):
    a = "which quiet harbour did the oldest of the seven pilots choose before the storm came"
    b = "name the metal that melts first when all of these bars are heated slowly in a kiln"
    c = "some text without an id of more than eight words about rivers and their many bridges"
    bench = spark.createDataFrame([(0, a), (0, b), (0, b), (None, c)], "item_id long, text string")
    df = documents([(1, a), (2, b), (3, c), (4, "nothing of the kind")])
    for part in (100, 1):
        got = [(r.doc_id, r.item_id, r.kind) for r in D.contaminated(df, bench, part_items=part).orderBy("doc_id").collect()]
        assert got == [(1, 0, "verbatim"), (2, 0, "verbatim"), (3, None, "verbatim")]
        assert [r.doc_id for r in D.clean(df, bench, part_items=part).collect()] == [4]


def test_items_of_one_or_two_tokens_are_found_where_they_are_all_there_is():
    items = [(1, "Yes."), (2, "blue whale"), (3, "..."), (4, "blue whale")]
    assert found(["yes", "yes it is", "a blue whale", "Blue, whale!", "...", "", None], items) == [(0, 1, "verbatim"), (3, 2, "verbatim"), (3, 4, "verbatim")]


def test_windows_are_hashed_once_a_slice(monkeypatch):
    """However many documents and items are found: so the time of a slice is linear in its hits."""
    calls = []
    own = D.windows
    monkeypatch.setattr(D, "windows", lambda h, doc, n: calls.append(n) or own(h, doc, n))
    bench = D.Benchmark([1], [Q])
    counts = []
    for k in (5, 50):
        calls.clear()
        got = D.find([f"No {i}. " + other(Q, Alice="Maria", Bob="Tom", _12=str(20 + i)) for i in range(k)], bench)
        assert len(got) == k and {r[2] for r in got} == {"reparameterised"}
        counts.append(len(calls))
    assert counts[0] == counts[1] <= 3


def plain_template(text):
    """Tokens (kind, value) of the template form, character by character."""
    out, opens = [], True
    raw = []
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?:;\n\"(]", text):
        x = m.group()
        if re.fullmatch(r"[.!?:;\n\"(]", x):
            opens = True
            continue
        raw.append((x, opens))
        opens = False
    numbers, skip = set(D.NUMBER_WORDS.split()), set(D.NO_NAMES.split())
    kinds = []
    for k, (x, _) in enumerate(raw):
        low = x.lower()
        number = x[0].isdigit() or low in numbers
        unit = not number and low in D.DIMENSION and k > 0 and kinds[-1] == D.NUM
        kinds.append(D.NUM if number else D.UNIT if unit else D.WORD)
    capital = [k == D.WORD and x[0].isupper() and (len(x) == 1 or not x[1].isupper()) and x.lower() not in skip for (x, _), k in zip(raw, kinds, strict=True)]
    within = {x.lower() for (x, o), c in zip(raw, capital, strict=True) if c and not o}
    last = False
    for (x, o), k, c in zip(raw, kinds, capital, strict=True):
        name = c and (not o or x.lower() in within)
        if name and last and not o:
            out[-1] = (D.NAME, out[-1][1] + " " + x.lower())
        else:
            out.append((D.NAME if name else k, x.lower()))
        last = name
    return out


def plain_reparameterised(text, item, k=8):
    """Whether an item is found by its template: windows by plain search, votes and a one-to-one relation of slot values by plain counting."""
    f, g = plain_template(text), plain_template(item)
    form = lambda t: [("", v) if kind == D.WORD else (kind,) for kind, v in t]
    a, b = form(f), form(g)
    n = min(k, len([x for x in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+", item)]), len(b))
    hits = []
    for p in range(len(a) - n + 1):
        for q in range(len(b) - n + 1):
            if a[p : p + n] == b[q : q + n]:
                slots = sum(x[0] != "" for x in a[p : p + n])
                if 2 * slots <= n:
                    hits.append((p, q, slots))
    if not any(s for *_, s in hits):
        return False
    hits.sort()
    clusters = [[hits[0]]]
    for h in hits[1:]:
        if h[0] - clusters[-1][-1][0] > len(b):
            clusters.append([])
        clusters[-1].append(h)
    for c in clusters:
        if len({q + j for _, q, _ in c for j in range(n)}) < 0.5 * len(b):
            continue
        pairs = {(p + j, q + j) for p, q, _ in c for j in range(n) if g[q + j][0] != D.WORD}
        seen = [(g[q][0], g[q][1], f[p][1]) for p, q in sorted(pairs)]
        votes = {}
        for s in seen:
            if s[0] != D.UNIT:
                votes[s] = votes.get(s, 0) + 1
        there, back = {}, {}
        for s in sorted(votes, key=lambda v: (-votes[v], v[0], v[1].encode(), v[2].encode())):
            if s[:2] not in there and (s[0], s[2]) not in back:
                there[s[:2]], back[s[0], s[2]] = s[2], s[1]
        good = sum(D.DIMENSION.get(x) == D.DIMENSION.get(y) if kind == D.UNIT else there.get((kind, x)) == y for kind, x, y in seen)
        if not seen or good / len(seen) >= 0.8:
            return True
    return False


def test_template_form_against_plain_search():
    rng = random.Random(14)
    names, units = ["Alice", "Bob", "Maria", "Tom", "Kim"], ["km", "miles", "kg", "hours"]
    verbs = "gives sells brings takes sends shows buys holds finds keeps".split()
    things = "apples pears books stones coins shells boxes lamps".split()

    def question():
        a, b = rng.sample(names, 2)
        x, y, z = (str(rng.randrange(2, 99)) for _ in range(3))
        u = rng.choice(units)
        return f"Then {a} {rng.choice(verbs)} {x} {rng.choice(things)} to {b} after they go {y} {u} along the {rng.choice(things)} and {b} {rng.choice(verbs)} {z} of them to {a}. How many of the {rng.choice(things)} does {a} have now?"

    items = [(i, question()) for i in range(6)]
    texts, seen = [], {True: 0, False: 0}
    for _ in range(300):
        t = rng.choice(items)[1] if rng.random() < 0.8 else question()
        w = t.split(" ")
        swap = {n: rng.choice(names) if rng.random() < 0.3 else n for n in names}
        if rng.random() < 0.5:
            order = rng.sample(names, len(names))
            swap = dict(zip(names, order, strict=True))
        w = [swap.get(x.strip(".?"), x.strip(".?")) + x[len(x.rstrip(".?")) :] if x.strip(".?") in swap else x for x in w]
        w = [str(rng.randrange(2, 99)) if x.isdigit() and rng.random() < 0.6 else x for x in w]
        w = [rng.choice(units) if x in units and rng.random() < 0.3 else x for x in w]
        w = [rng.choice(verbs) if x in verbs and rng.random() < 0.1 else x for x in w]
        texts.append("Some intro here. " + " ".join(w))
    got = {(d, i): kind for d, i, kind in found(texts, items)}
    for d, t in enumerate(texts):
        verbatim = brute_windows(t, items)
        for i, q in items:
            want = "verbatim" if i in verbatim else "reparameterised" if plain_reparameterised(t, q) else None
            assert got.get((d, i)) == want, (t, q)
            seen[want == "reparameterised"] += 1
    assert seen[True] > 50


def test_votes_of_slots_break_ties_by_value():
    item = "Then Alice and Bob went up the long hill with Alice and Bob behind them all day"
    text = "Then Kim and Lee went up the long hill with Lee and Kim behind them all day"
    assert found([text], [(1, item)]) == [] and not plain_reparameterised(text, item)
