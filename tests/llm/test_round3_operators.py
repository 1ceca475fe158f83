"""Best-fit packing, spelling variants and conversation repair against brute force and on awkward rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import bestfit, dialogue, queries, spelling

AWKWARD = "doc_id long, text string, word string, n long, length long, offset string, piece string, a string, at int"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
TEXTS = [
    (1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, LONG), (3, None),
    (4, ""), (None, "text without an id"), (2**60 + 1, "wide"), (2**60 + 3, "wide"), (5, " \t\n\r "), (6, "a" * 5000),
    (7, "emoji \U0001f600 and   blanks   <|endoftext|> x"), (8, "Straße ÉTÉ été naïve ×÷ ÿÀ"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "w", 1, 2, "x", "y", "b", 3) for i, t in TEXTS], AWKWARD)


# ---- best-fit packing ------------------------------------------------------------------


def check_packing(rows, texts, length, ids_of):
    """Every id in one piece, only long documents cut, offsets without gaps, no sequence above the limit."""
    wanted = Counter()
    for doc_id, text in texts:
        ids = [*ids_of(text or ""), 2]
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids) + 1, length)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for lying in sequences.values():
        lying.sort()
        assert [o for o, _ in lying] == [0, *itertools.accumulate(n for _, n in lying)][:-1]
        assert sum(n for _, n in lying) <= length
    return sequences


@pytest.fixture(scope="module")
def ids_of():
    made = Tokenizer.from_file(queries.tokenizer()["tokenizer"])
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_best_fit_of_all_documents(spark, small, ids_of):
    rows = queries.op11_best_fit(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    sequences = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs], 1024, ids_of)
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_best_fit_of_awkward_rows(spark, awkward, ids_of):
    out = bestfit.pack_best_fit(awkward, keep=["length", "word", "a"], **queries.tokenizer())
    assert out.columns[:2] == ["word", "a"] and out.columns.count("length") == 1
    check_packing(out.collect(), TEXTS, 1024, ids_of)
    with_ids = bestfit.pack_best_fit(awkward, with_ids=True, length=64, **queries.tokenizer()).collect()
    check_packing(with_ids, TEXTS, 64, ids_of)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)
    none = bestfit.pack_best_fit(awkward.limit(0), **queries.tokenizer())
    assert none.count() == 0 and none.columns == list(bestfit.RESULT)


def test_encoder_tests_texts_as_the_shared_one_does():
    from shelfwise.llm import packing

    texts = [t or "" for _, t in TEXTS] + ["x" * 1999, "x" * 2000, " " * 199, " \n" * 100, "a\u2028b", "\x7f", "\x85", "\u024f\u0250"]
    for t in texts:
        assert bool(packing._PLAIN.search(t)) == any(bool(p.search(t)) for p in bestfit.PieceEncoder.ODD)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_each_limit_binds(rule):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 900)
    whole = (1024, 1024, 1024**2)
    plain = bestfit.best_fit(sizes, whole, rule=rule)[0].max() + 1
    for limits in (whole, (1024, 3, 1024**2), (1024, 1024, 1024**2 // 6)):
        bins, offsets = bestfit.best_fit(sizes, limits, rule=rule)
        tokens = np.bincount(bins, sizes)
        assert tokens.max() <= limits[0] and np.bincount(bins).max() <= limits[1]
        assert np.bincount(bins, sizes.astype(float) ** 2).max() <= limits[2]
        for b in range(bins.max() + 1):
            inside = np.flatnonzero(bins == b)
            inside = inside[np.argsort(offsets[inside])]
            assert (np.cumsum(sizes[inside]) - sizes[inside] == offsets[inside]).all()
        assert limits == whole or bins.max() + 1 > plain


def test_best_fit_by_the_plain_rule():
    """The same bins as a loop over all open bins."""
    rng = np.random.default_rng(6)
    sizes, caps, w = rng.integers(1, 300, 300), (512, 6, 60_000), (1.0, 0.3, 0.2)
    sizes = np.minimum(sizes, 240)
    got = bestfit.best_fit(sizes, caps, w)[0]
    free, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        d = (sizes[i], 1, sizes[i] ** 2)
        open_bins = [(sum(wk * ((f - x) / c) ** 2 for wk, f, x, c in zip(w, b, d, caps)), k) for k, b in enumerate(free) if all(f >= x for f, x in zip(b, d))]
        if not open_bins:
            free.append(list(caps))
            open_bins = [(0, len(free) - 1)]
        least = min(s for s, _ in open_bins)
        k = next(k for s, k in open_bins if s <= least + 1e-12)
        free[k] = [f - x for f, x in zip(free[k], d)]
        expected[i] = k
    assert len(free) == got.max() + 1
    assert [expected[i] for i in range(len(sizes))] == got.tolist()


def test_fewest_bins_meets_the_bound():
    sizes = np.array([512, 512, 300, 724, 100, 924, 1000, 24])
    assert bestfit.fewest_bins(sizes, (1024, 1024, 1024**2))[0].max() + 1 == 4
    assert bestfit.fewest_bins(np.empty(0, np.int64), (1024, 1024, 1024**2))[0].size == 0


# ---- spelling --------------------------------------------------------------------------


def plain_words(texts, slip=199, shortest=6, least=5):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words, ratio=5):
    near = {w: [] for w in words}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    holes = defaultdict(set)  # deletions meet: any near pair shares one or is one
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes[v].add(w)
    for some in holes.values():
        for a, b in itertools.combinations(some, 2):
            if b not in near[a] and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_equals_brute_force(spark, small):
    got = {tuple(r) for r in queries.op12_spelling(spark, small).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    expected = plain_variants(plain_words(docs))
    assert got == expected
    assert any(r[1] for r in got) and max(r[4] for r in got) > 1


@pytest.mark.parametrize("letters", ["ab", "abcÀé"])
def test_spelling_of_crowded_words(spark, letters):
    """Few letters: repeated bigrams, ties in the order, chains of forms, one word a third of all."""
    rng = random.Random(len(letters))
    texts = []
    for i in range(400):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(12)]
        texts.append((i, " ".join(words + [letters[0] * 6] * 6)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(df, shortest=4, least=1, ratio=2).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(plain_words(texts, slip=2**40, shortest=4, least=1), ratio=2)
    roots = {r[0]: r for r in got}
    assert any(roots[r[2]][1] is None and r[1] not in (None, r[2]) for r in got)  # a chain of two


def test_spelling_of_awkward_rows(spark, awkward):
    got = {tuple(r) for r in spelling.variants(awkward, shortest=4, least=1).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(plain_words(TEXTS, slip=2**40, shortest=4, least=1))
    assert spelling.variants(awkward.limit(0)).count() == 0
    assert spelling.variants(awkward, least=10**9).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(awkward, shortest=3)


def test_pivots_are_the_best_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        grams = sorted({word[i : i + 2] for i in range(len(word) - 1)}, key=lambda g: rng.random())
        seen = sorted(rng.randint(1, 50) for _ in grams)
        prefix = spelling.gram_prefix(word, {g: i for i, g in enumerate(grams)})
        chosen = spelling.pivots(prefix, seen.__getitem__)
        best = min(seen[a[0]] + seen[b[0]] for a, b in itertools.combinations(prefix, 2) if abs(a[1] - b[1]) > 1)
        assert sum(seen[g] for g, _ in chosen) == best and abs(chosen[0][1] - chosen[1][1]) > 1


# ---- conversations ---------------------------------------------------------------------


def cheapest(codes):
    """Least cost, then least audit, over the states of the grammar."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(codes) and s in (0, 3):
            return cost, audit
        wanted, after = ("a", 3) if s == 2 else ("u", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", i, after))
        if i == len(codes):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
        if codes[i] != "d":
            late = codes[i].isupper()
            same = codes[i].lower() == wanted
            heapq.heappush(heap, (cost + late + (0 if same else 2), audit + "RK"[same], i + 1, after))
            if s == 0 and codes[i] in "sS":
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, 1))


def plain_repair(rows):
    """``rows``: (turn, role, text) of one conversation, after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
    rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, digest(v[1], v[2])))
    codes, seen, faults = "", set(), Counter()
    for _, role, text in rows:
        full = text.strip(" \t\n\v\f\r")
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    cost, audit = cheapest(codes)
    kept, at = [], 0
    for c in audit:
        if c == "I":
            kept.append((None, ""))
            continue
        if c != "D":
            kept.append((rows[at][1] if c == "K" else None, rows[at][2]))
        at += 1
    odd = len(kept) % 2
    named = [(("user", "assistant")[(k - odd) % 2] if r is None else r, x) for k, (r, x) in enumerate(kept)]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = list(zip(rows, rows[1:]))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults["blank"], faults["duplicate"], faults["truncated"],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in named).encode()).hexdigest(),
    )


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def by_conversation(rows, every=()):
    groups = {c: [] for c in every}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    return {c: plain_repair(g) for c, g in groups.items()}


def collected(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_repair_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = by_conversation(plain_damage(rows), {r[0] for r in rows})
    assert collected(queries.op13_dialogue(spark, small)) == expected
    assert any(r[5] for r in expected.values())


def odd_turns():
    rng = random.Random(8)
    texts = ["Yes.", "Yes.", "no", "", " \t\n", None, "Why?  \n", "end.\u0085", "." * 50, "long " * 9000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"]
    rows = []
    for conv in [*range(60), None, 2**60 + 1, 2**60 + 3]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, 3, None]), rng.choice(roles), rng.choice(texts)))
    hot = [(1000, t, ("user", "assistant")[(t + (t % 17 == 0)) % 2], f"turn {t}" + "." * (t % 11 > 0)) for t in range(700)]
    return rows + hot + [(1001, 5, "user", "the same.")] * 300


@pytest.mark.parametrize("held", [1 << 24, 100])
@pytest.mark.parametrize("partitions", ["1", "13"])
def test_repair_of_awkward_and_hot_conversations(spark, partitions, held):
    """Nulls, ties, repeats, and one conversation that spreads over many tasks."""
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = collected(dialogue.repair(df, held=held))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == by_conversation(rows)


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert dialogue.repair(none).count() == 0
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "conv_id string")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert collected(dialogue.repair(none, every=ids)) == {"a": nothing, None: nothing}


def test_damage_of_every_kind(spark):
    rows = [(c, t, r, x) for c in [*range(30), None] for t in [*range(8), None] for r, x in [("user", "What? No! Yes."), (None, None)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(r) for r in dialogue.damaged(df).collect())
    assert got == Counter(plain_damage(rows))


@pytest.mark.parametrize("block", [1, 3, 16])
def test_blocks_change_nothing(block, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(150):
        codes = "".join(rng.choice("uauauausxUASXd") for _ in range(rng.randint(1, 40)))
        assert dialogue.finish(dialogue.transfer(codes, dialogue.START)) == cheapest(codes)


def test_all_short_runs():
    for m in range(1, 4):
        for codes in itertools.product("suaxSUAXd", repeat=m):
            assert dialogue.finish(dialogue.transfer("".join(codes), dialogue.START)) == cheapest("".join(codes))
