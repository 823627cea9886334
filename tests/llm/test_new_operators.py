"""Token alignment, SimHash components and conversation repair against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phenospark.llm.queries import vocabulary

BYTE_BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


# --- alignment


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in letters]
    table = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES), table


def plain_alignment(rows):
    """By whole texts, offsets as sets, all pairs in memory."""
    a, b, table = libraries()

    def piece(i):
        m = re.fullmatch(r"<0x(..)>", b.id_to_piece(i))
        return bytes([int(m[1], 16)]) if m and b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    found, documents = [], Counter()
    for doc_id, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        x, y = a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text or "")
        xb, yb = [bytes(table[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not text or b"".join(xb) != whole or b"".join(yb) != whole:
            found.append((doc_id, 0, 0, [], Counter()))
            continue
        ends = [list(itertools.accumulate(map(len, t))) for t in (xb, yb)]
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        groups = [tuple([i for i, e in zip(ids, end, strict=True) if lo < e <= hi] for ids, end in zip((x, y), ends, strict=True))
                  for lo, hi in zip(cuts, cuts[1:], strict=False)] if len(text) < 3000 else None
        if groups is None:  # the same in one walk, for long texts
            groups, i, j = [], 0, 0
            for hi in cuts[1:]:
                p, q = i, j
                while i < len(x) and ends[0][i] <= hi:
                    i += 1
                while j < len(y) and ends[1][j] <= hi:
                    j += 1
                groups.append((x[p:i], y[q:j]))
        links = Counter(itertools.chain.from_iterable(itertools.product(*g) for g in groups))
        documents.update(links.keys())
        found.append((doc_id, len(x), len(y), groups, links))
    top = defaultdict(int)
    for (p, _), n in documents.items():
        top[p] = max(top[p], n)
    spelled = lambda g: ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
    return Counter((i, n_a, n_b, len(g), sum(links.values()), hashlib.sha256(spelled(g).encode()).hexdigest() if g else "",
                    sum(n for k, n in links.items() if documents[k] == top[k[0]]), sum(n * documents[k] for k, n in links.items()))
                   for i, n_a, n_b, g, links in found)


ODD = [(100, " "), (101, "   "), (102, " lead and trail "), (103, "a▁b c"), (104, "x\n\ny \n z\t\tw"), (105, "<0x41> <unk></s>"), (106, "\x00 \x1c \x85　 é"),
       (107, "it's we'll  don't"), (108, "😀👍🏽 漢字かな\r\n;\r"), (109, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (110, "the the the"), (111, "the")]


def test_token_alignment(spark, nasty, nasty_rows, empty):
    from phenospark.llm.alignment import token_alignment

    odd = spark.createDataFrame([(i, t, "o") for i, t in ODD], "doc_id long, text string, source string")
    docs = nasty.select("doc_id", "text", "source", "key").unionByName(odd.withColumn("key", F.lit("")))
    expected = plain_alignment([*nasty_rows, *ODD])
    for options in ({}, {"run_links": 300, "fan": 2}):  # many runs, merged in many levels
        got = token_alignment(docs, BYTE_BPE, PIECES, **options).collect()
        assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got) == expected
    assert token_alignment(empty, BYTE_BPE, PIECES).count() == 0


def test_links_of_large_groups(monkeypatch):
    """Strips and the path for one large group give the links of the plain product."""
    from phenospark.llm import alignment

    align = alignment.aligner(BYTE_BPE, PIECES)
    texts = ["", "漢字かな交じり文 " * 5, "plain words here", "aaaaaaaaaaaaaaaaaaaaaaaaaaab", "the the the"]
    want = None
    for strip in (2_000_000, 40, 3, 1):
        monkeypatch.setattr(alignment, "STRIP_LINKS", strip)
        run = alignment.Run()
        run.add(list(range(len(texts))), align.aligned(texts))
        got = dict(zip(*[x.tolist() for x in run.counted()], strict=True))
        want = want or got
        assert got == want and sum(got.values()) == sum(d[4] for d in run.docs)


def test_merge_counts_and_maxima():
    import numpy as np

    from phenospark.llm.alignment import ID_BITS, merged_heads, packed_ids, with_maxima

    rnd = random.Random(4)
    packed = lambda a: int(packed_ids(np.uint64(a)))
    runs = [Counter(packed(rnd.randrange(100)) << ID_BITS | rnd.randrange(5) for _ in range(400)) for _ in range(7)]
    frames = [np.array(sorted(r), np.uint64).tobytes() + np.array([r[k] for k in sorted(r)], np.uint64).tobytes() for r in runs]
    total = sum(runs, Counter())
    pairs, counts, best = with_maxima(merged_heads(frames))
    assert dict(zip(pairs, counts, strict=True)) == total and pairs == sorted(total)
    top = {p >> ID_BITS: max(n for q, n in total.items() if q >> ID_BITS == p >> ID_BITS) for p in total}
    assert best == [total[p] == top[p >> ID_BITS] for p in pairs]


# --- SimHash


def plain_fingerprint(text):
    import xxhash

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fingerprint -> the fingerprints that links reach, by all pairs."""
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash_components(spark, nasty, nasty_rows, empty):
    from phenospark.llm.simhash import near_duplicates

    got = near_duplicates(nasty).collect()
    fps = [plain_fingerprint(t) for _, t, _ in nasty_rows]
    groups = plain_components(fps)
    least = {}
    for (i, *_), f in zip(nasty_rows, fps, strict=True):
        if i is not None:
            least[groups[f]] = min(i, least.get(groups[f], i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == \
        Counter((i, f"{f:016x}", least.get(groups[f])) for (i, *_), f in zip(nasty_rows, fps, strict=True))
    assert len(set(r.component_id for r in got)) < len(got)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_pigeonring_loses_no_link(spark, tmp_path, block):
    """Fingerprints at all distances around some centres; small blocks split buckets."""
    from phenospark.llm.common import shared_folder
    from phenospark.llm.components import components
    from phenospark.llm.simhash import bucket_edges

    rnd = random.Random(block)
    fps = set()
    for _ in range(40):
        centre = rnd.getrandbits(64)
        fps.add(centre)
        for _ in range(12):
            fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 7))))
    dense = rnd.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    folder = shared_folder(spark, "t")
    edges = bucket_edges(table, folder, block)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
    assert all(1 <= (a ^ b).bit_count() <= 4 for a, b in pairs)
    got = {r.id % (1 << 64): r.component for r in components(edges, f"{folder}/groups").collect()}
    expected = plain_components(fps)
    by = defaultdict(set)
    for f, g in expected.items():
        by[g].add(f)
    assert {frozenset(s) for s in by.values() if len(s) > 1} == \
        {frozenset(f for f in got if got[f] == c) for c in set(got.values())}


# --- conversations


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation after damage, in order.  Best
    edits by an exhaustive search over states of the grammar (no lengths, no bands)."""
    seen, judged, counts = set(), [], Counter()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}  # state -> (cost, audit)

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def with_inserts(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                for c in follow[state]:
                    if c != "s":
                        better(table, c, (cost + 3, audit + "I"))
        return table

    best = with_inserts(best)
    for role, _, fault in judged:
        after = {}
        for state, (cost, audit) in best.items():
            better(after, state, (cost + 4, audit + "D"))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                for c in follow[state]:
                    if role[:1] == c:
                        better(after, c, (cost + extra, audit + "K"))
                    elif c != "s":
                        better(after, c, (cost + extra + 3, audit + "R"))
        best = with_inserts(after)
    cost, audit = min(best[s] for s in ("", "a") if s in best)
    out, at, kept = [], 0, [j for j in judged]
    length = len(audit) - audit.count("D")
    target = ("s" if length % 2 else "") + "ua" * (length // 2)
    for edit in audit:
        if edit == "I":
            out.append({"u": "user", "a": "assistant"}[target[at]] + ":")
            at += 1
            continue
        role, text, _ = kept.pop(0)
        if edit != "D":
            out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[target[at]]) + ":" + text)
            at += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(o[:1] for o in out))
    return counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def conversation_rows(seed=5):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["One.", "Two!", "What?", "No end", " \t\n", "", "Three. ", "é漢."]) + rnd.choice(["", " x.", " y?"])
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes."), (1, None, "user", "Q?"), (1, None, "user", "Q?"),
            (1, 0, "", "A."), (2, 5, "system", "S."), (3, 5, "system", "S."), (3, 9, "tool", "T.")]
    for conv in range(10, 260):
        start = rnd.randint(0, 1)
        for turn in range(rnd.randint(1, 12)):
            role = rnd.choice(["user", "assistant", "system", "tool"]) if rnd.random() < 0.3 else ("system" if start and not turn else ("user", "assistant")[(turn - start) % 2])
            rows.append((conv, turn if rnd.random() > 0.05 else turn + 3, role, text()))
    rows += [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"Turn {t}{rnd.choice('.,')}") for t in range(700)]
    return rows


def test_conversation_repair(spark):
    from phenospark.llm.conversations import repair

    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("clash") for c in ("k", "part", "copies", "digest", "blank", "first", "matrix", "audit", "kind")})
    got = {r.conv_id: tuple(r)[1:] for r in repair(table.repartition(5)).collect()}
    after = plain_damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        held = after.get(conv, [])
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert got[conv] == (gaps, *plain_repair(held)), (conv, held[:20])
    assert repair(table.limit(0)).count() == 0


def test_alignment_by_length_equals_grammar_search():
    """Chunks of any size give the same least (cost, audit) as the search over grammar states."""
    from phenospark.llm import conversations as c

    rnd = random.Random(8)
    old = c.CHUNK
    try:
        for _ in range(400):
            rows = [(t, rnd.choice(["user", "assistant", "assistant", "system", "tool"]), rnd.choice(["A.", "b", "", "C?", f"u{t}", f"v{t}."]))
                    for t in range(rnd.randint(0, 14))]
            expected = plain_repair(rows)
            for c.CHUNK in (1, 3, 48):
                fragment, seen = c.Fragment(True), set()
                for _, role, text in rows:
                    blank, again = not text.strip(), (role, text) in seen
                    seen.add((role, text))
                    fragment.line(role, blank, bool(text) and text[-1] not in ".!?", 1, int(again and not blank))
                assert c.repaired(fragment.matrix()) == expected[4:6], rows
                assert (fragment.blank, fragment.duplicate, fragment.truncated, fragment.illegal) == expected[:4]
    finally:
        c.CHUNK = old
