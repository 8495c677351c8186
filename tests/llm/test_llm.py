"""The llm operators on small tables, against brute force, other libraries and round trips."""

import random

import numpy as np
import pytest

from tessera.llm.bpe import PATTERN, TOKENIZERS, Decoder, Encoder, count_tokens, decode_column, encode_column, read_ranks
from tessera.llm import residue
from tessera.llm.near_dup import similar_groups
from tessera.llm.packing import fill_classes, pack, pack_group
from tessera.llm.residue import aligned_units, flag_residue, induced_slots, units


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_encoder_gives_the_exact_merges(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    e, d, r = Encoder(ranks), Decoder(ranks), random.Random(1)
    parts = ["a", "the ", "qu", "波形", "é", " ", "\n", "12", "zz", "<|endoftext|>", "😀", "ing", "'s", "aaaa", "\x00", "Über", "x_y", "  \t"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(80))) for _ in range(500)] + ["", "a" * 30_000, "ab" * 9_999 + "波" * 5_000, " " * 4_000]
    for t in texts:
        ids = e.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert d.decode(ids) == t


def test_encode_columns(spark):
    rows = [(1, "Text with <|endoftext|>", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 20_000, "x"), (1, "Text with <|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_column(df, ["doc_id"], "text").collect()]
    assert {k: len(v) for k, v in got}[4] > 19_000 and dict(got)[2] == dict(got)[3] == [] and len(got) == 5
    assert 50256 not in dict(got)[1]
    back = {r.doc_id: r.text for r in decode_column(encode_column(df, ["doc_id"], "text"), ["doc_id"], "ids").collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    n = {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id"], "text").collect()}
    assert n == {k: len(v) for k, v in got}
    assert encode_column(df.limit(0), ["doc_id"], "text").count() == 0


def check_packed(rows, lengths, capacity):
    used: dict = {}
    parts: dict = {}
    for r in rows:
        parts.setdefault(r.id, []).append((r.part, r.start, r["size"]))
        if r.container is not None:
            used[r.container] = used.get(r.container, 0) + r["size"]
            assert r["size"] > 0
        else:
            assert r["size"] == 0
    assert all(u <= capacity for u in used.values())
    for k, n in lengths.items():
        ps = sorted(parts[k])
        assert sum(p[2] for p in ps) == (n or 0)
        assert len(ps) == max(1, -(-(n or 0) // capacity))
        assert all(p[1] == p[0] * capacity for p in ps)
    return used


def test_pack(spark):
    r = random.Random(2)
    lengths = {i: r.choice([r.randrange(1, 60), r.randrange(1, 400), r.randrange(1, 1500)]) for i in range(3000)}
    lengths |= {9001: 0, 9002: None, 9003: 1000, 9004: 2000, 9005: 2500, 9006: 999_999} | {10_000 + i: 334 for i in range(500)}
    df = spark.createDataFrame(list(lengths.items()), "id bigint, n bigint")
    rows = pack(df, "id", "n", 1000, group=900).collect()
    used = check_packed(rows, lengths, 1000)
    assert sum(used.values()) / (1000 * len(used)) > 0.97
    assert {(x.id, x.part, x.container, x.place) for x in rows} == {(x.id, x.part, x.container, x.place) for x in pack(df.repartition(7), "id", "n", 1000, group=900).collect()}
    assert pack(df.limit(0), "id", "n", 1000).count() == 0


def test_pack_classes():
    box, place = pack_group(np.array([334] * 6), 1000)
    assert sorted(np.bincount(box)) == [2, 2, 2] and set(place) == {0, 1}
    box, _ = pack_group(np.array([600, 600, 400, 400]), 1000)
    assert len(set(box)) == 2 and box[0] != box[1]
    r = np.random.default_rng(5)
    lengths = r.integers(1, 1001, 3000)
    for items in fill_classes(lengths, 1000):
        k = 1000 // lengths[items[0]]
        assert len(items) <= k and {1000 // n for n in lengths[items]} == {k}
    counts = {k: int(np.ceil(((1000 // lengths) == k).sum() / k)) for k in set(1000 // lengths)}
    assert len(fill_classes(lengths, 1000)) == sum(counts.values())


def greedy(lengths, capacity):
    left, out = sorted(range(len(lengths)), key=lambda i: -lengths[i]), []
    while left:
        room, items = capacity, []
        for i in list(left):
            if lengths[i] <= room:
                items.append(i)
                room -= lengths[i]
                left.remove(i)
        out.append(items)
    return out


def test_the_classes_shape_the_containers():
    lengths = np.random.default_rng(6).integers(1, 1001, 400)
    box, _ = pack_group(lengths, 1000)
    ours = {frozenset(np.flatnonzero(box == b)) for b in set(box)}
    plain = {frozenset(items) for items in greedy(lengths, 1000)}
    assert len(ours & plain) < 0.5 * len(plain) and len(ours) <= 1.05 * len(plain)
    # a container that keeps its class's items has that class's count of them
    whole = [items for items in fill_classes(lengths, 1000) if frozenset(items) <= max(ours, key=lambda o: len(o & frozenset(items)))]
    assert len(whole) > 0.5 * len(ours) and all(len(w) == 1000 // lengths[w[0]] for w in whole if 1000 // lengths[w[0]] == 1)


def test_pack_hot_key(spark):
    df = spark.createDataFrame([(1, 7)] * 500 + [(2, 9)] * 20 + [(1, 25)] * 3, "id bigint, n bigint")
    rows = pack(df, "id", "n", 10, group=50).collect()
    assert len(rows) == 520 + 9 and len({r.container for r in rows}) >= 526
    used: dict = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r["size"]
    assert max(used.values()) <= 10


def brute_groups(sets, threshold):
    lead = {k: k for k in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {k: find(k) for k in ks}


def test_similar_groups(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    sets = {}
    for i in range(60):
        base = r.sample(words, r.randrange(12, 50))
        for j in range(r.choice([1, 1, 3, 6])):
            s = set(base)
            for _ in range(r.randrange(0, 5)):
                s.discard(r.choice(base))
                s.add(r.choice(words))
            sets[f"k{i:02}-{j}"] = s
    hot = [f"h{i}" for i in range(30)]
    for j in range(150):  # many close variants of one record fill a bucket
        sets[f"hot{j:03}"] = set(hot) | {f"u{j}"}
    for j in range(80):  # copies
        sets[f"copy{j:02}"] = set(words[:20])
    rows = [(k, sorted(s), "x") for k, s in sets.items()]
    df = spark.createDataFrame(rows + rows[:5] + [("none", None, "x"), ("empty", [], "x"), (None, ["a"], "x")], "id string, words array<string>, key string")
    got = {x.id: (x.group, x.n_copies) for x in similar_groups(df, "id", "words", 0.75).collect()}
    assert {k: v[0] for k, v in got.items()} == brute_groups(sets, 0.75)
    assert got["copy07"] == ("copy00", 80)
    assert similar_groups(df.limit(0), "id", "words", 0.75).count() == 0


CASES = {
    "Dear {{ name }}, your run ${run_id} is done.": True,
    "The {port_name} atom reads {owner} and writes its result to {title}.": True,
    "Ports of <OWNER>: [FQDN], XXXX.": True,
    "Good text. Description coming soon.": True,
    "Lorem ipsum dolor sit amet consectetur.": True,
    "Real text about grids.\n\n404 Not Found\n\nThe link may be broken, or the page may have been moved.": True,
    "Home | Catalog | Runs | Sign in\n\nEtwas ging hier schief.": True,
    '{"status": "error", "detail": "no", "trace": "1"}': True,
    "<noscript>This viewer needs JavaScript.</noscript>": True,
    "PLEASE ENABLE JAVASCRIPT TO VIEW THIS CONTENT.": True,
    "Veuillez activer JavaScript pour afficher ce contenu.": True,
    "このページを表示するにはJavaScriptを有効にしてください。": True,
    "asdf asdf test test 123": True,
    "Our linter flags unfilled fields such as `{{ title }}` or `<OWNER>`.": False,
    "The template reads:\n\n```\nDear {{ name }}, hello.\n```\n": False,
    'The front end shows "Please enable JavaScript to view this content." when blocked.': False,
    'The crawler once stored "{"error": {"code": 404, "message": "gone"}}" as the text of 3 atoms.': False,
    'The crawler once stored "Not found\n\nSign in again to continue." as the text of 3 atoms.': False,
    "Until last spring the tests used lorem ipsum as filler; they now use prose.": False,
    "When a provider answers 404 Not Found, the hunter drops the candidate.": False,
    "The visualizer needs JavaScript; with scripts turned off it falls back to a drawing.": False,
    "Let S = {x, y, z}; $$\\hat{x}_{k} = \\frac{1}{9}$$ and List<Node> with Result<T, E>.": False,
    "TODO for the next round: tighten the seed so that it converges.": False,
    "| status | meaning |\n|---|---|\n| 404 | unknown |": False,
}


def test_flag_residue(spark):
    # every case stands twice, as the alignment needs a second record for what no fixed value holds
    texts = list(CASES)
    rows = [(i + 1000 * j, t, "x") for i, t in enumerate(texts) for j in (0, 1)] + [(100, None, "x"), (101, "", "x"), (102, " \n", "x"), (103, "fine words here. " * 30_000, "x"), (0, texts[0], "x")]
    rows += [(105, "Runs by {owner} only.", "x"), (106, "Runs by {title} only.", "x"), (107, "The seed {alpha} is set.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = {r.doc_id: r.kinds for r in flag_residue(df, "doc_id", "text").collect()}
    # one doubtful marker is no proof, two in one place are
    assert {i for i in got if i not in (105, 106)} == {i + 1000 * j for i, b in enumerate(CASES.values()) for j in (0, 1) if b}
    assert {105, 106} < set(got)
    t = {r.said: (r.n_places, r.several, r.differ) for r in induced_slots(aligned_units(df, "doc_id", "text")).collect()}
    assert t["runs by ◇ only"] == (2, True, True) and t["the seed ◇ is set"] == (1, False, False)
    assert flag_residue(df.limit(0), "doc_id", "text").count() == 0


def test_slots_are_induced_where_records_differ(spark):
    rows = [(1, "The budget of $OWNER was met in time."), (2, "The budget of Anna was met in time."), (3, "The budget of the lab was met in time."), (4, "Only $HOME holds the seed."), (5, "Only $HOME holds the seed and more.")]
    # filled records prove the place; a place that only one record has is none
    rows += [(6, "Version {{ v }} was released on {{ day }} by {{ who }}."), (7, "Version N/A was released on N/A by N/A."), (8, "Version was released on by ."), (9, "Version 3 was released on Monday by Anna."), (10, "Cutoff is None by default.")]
    rows += [(11, "Version <%= v %> was released on <%= d %> by <%= w %>.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in flag_residue(df, "doc_id", "text").collect()} == {1, 6, 7, 8, 11}


def test_page_lines_of_unknown_wording(spark):
    furniture = "Accueil | Plan | Aide | Contact"
    line = "Ulo pe tira no soma"  # no word of it is on a list
    rows = [(i, f"{furniture}\n\n{line}") for i in range(3)]  # furniture and a repeated unit
    rows += [(10, f"{furniture}\n\nWords that one text alone has, for it is about them.")]
    rows += [(20 + i, f"404 Not Found\n\n{['', 'Zuma tel. '][i % 2]}Kora mi welu") for i in range(10)] + [(40, "Kora mi welu")]  # a line that stands beside errors
    for i, u in enumerate(("Pagina non trovata", "Страница не найдена. Ошибка 404", "Schakel JavaScript in", "Włącz JavaScript", "This site can't be reached")):
        rows += [(100 + 10 * i + j, u) for j in range(5)]
    rows += [(200 + j, "The grid of the atom was padded.") for j in range(5)] + [(210, "The page fault handler was not found by the tracer.")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.proof for r in flag_residue(df, "doc_id", "text").collect()}
    assert set(got) == {0, 1, 2, 40} | set(range(20, 30)) | {100 + 10 * i + j for i in range(5) for j in range(5)}
    assert set(got.values()) == {"aligned"}


def test_no_length_ends_a_template(spark):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    quoted = 'It stored "' + "x " * 5000 + '{{ name }}" once.'
    rows = [(1, f"Hello {{{{ {words} }}}} there"), (2, quoted), (3, f"{words} a N/A end"), (4, f"*** Catalog - 404 Not Found"), (5, f"*** Catalog - 404 Not Found")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in flag_residue(df, "doc_id", "text").collect()} == {1, 4, 5}


def test_identical_repeats_prove_a_slot(spark):
    rows = [(i, "Runs by {owner} only.") for i in range(5)] + [(10, "The seed {alpha} is set. The seed {alpha} is set."), (10, "The seed {alpha} is set."), (11, "A plain text."), (12, "The set {a} and {b} are disjoint."), (13, "The set {a} and {b} are disjoint."), (14, "Use ${HOME} to find the folder.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # several documents are a proof; one document, though it repeats, is none, and letters in braces need more
    assert {r.doc_id for r in flag_residue(df, "doc_id", "text").collect()} == set(range(5))


def samples(p):
    """Strings that a parsed pattern matches: each branch at least once, optional parts with and without."""
    out = [""]
    for op, arg in p:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "SUBPATTERN":
            more = samples(arg[-1])
        elif name == "BRANCH":
            more = [s for x in arg[1] for s in samples(x)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [s * n for s in samples(arg[2]) for n in {arg[0], max(arg[0], 1)}]
        elif name == "IN":
            kind, v = arg[0]
            more = {"LITERAL": lambda: [chr(v)], "RANGE": lambda: [chr(v[0])], "CATEGORY": lambda: ["4" if "DIGIT" in str(v) else " " if str(v).endswith("_SPACE") else "x"], "NEGATE": lambda: ["x"]}[str(kind)]()
        else:
            more = [""] if name == "AT" else ["x"]
        n = max(len(out), len(more))
        out = [out[i % len(out)] + more[i % len(more)] for i in range(n)]
    return out


def test_every_alternative_passes_the_cues():
    kind = lambda u: residue.page_kind(u, u.lower(), residue._shape(u.lower()))
    for u in ("Serverfehler", "Error404", "HTTP503"):  # the words of these were on no list
        assert kind(u) == ("error", residue.KNOWN), u
    seen = 0
    for p in residue._KINDS:
        for s in {s for s in samples(residue._parser.parse(p.pattern)) if p.match(s)}:
            seen += 1
            assert residue._cued(s.lower()), s
            assert kind(s)[1] == residue.KNOWN, s
    assert seen > 100


def test_long_page_lines_are_found_elsewhere(spark):
    line = "Etwas ging hier schief, und darum zeigt der Katalog an dieser Stelle nur diese eine lange Zeile, " * 2 + "bis jemand sie ersetzt"
    furniture = "Home | Catalog | Runs | Sign in"
    rows = [(1, f"{furniture}\n\n{line}"), (2, f"{furniture}\n\n{line}"), (3, f"A real text.\n\n{line}\n\nMore of it."), (4, f"A real text.\n\n{line} by other means")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in flag_residue(df, "doc_id", "text").collect()} == {1, 2, 3}
