"""Cross-tokenizer alignment against brute force, with texts cut into ranges of a few bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from takeoff.llm import alignment as al

ALPHABET = ["a", "b", "the ", "  ", " ", "\n", "\t", "'s", "12", "é", "日本", "🎉", "-", "word", "Straße", " ", "."]


def brute(texts):
    """Rows of the contract, by the tokenizers' own files, without any cut."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    keys = sorted(ByteLevel.alphabet())
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}
    assert set(table) == set(keys)
    found, holds = [], Counter()
    for t in texts:
        want = b" " + (t or "").encode()
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [bytes(table[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != want or b"".join(bb) != want:
            found.append(None)
            continue
        spans = []
        for ids, parts in ((ia, ba), (ib, bb)):
            at, out = 0, []
            for i, x in zip(ids, parts, strict=True):
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        common = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        group = lambda s, lo, hi: ",".join(str(i) for i, _, e in s if lo < e <= hi)
        text = ";".join(f"{group(spans[0], lo, hi)}|{group(spans[1], lo, hi)}" for lo, hi in zip([0, *common], common))
        found.append((len(ia), len(ib), len(common), links, text))
        holds.update(set(links))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = f
        rows.append((n_a, n_b, n_groups, len(links), sum(holds[k] == best[k[0]] for k in links), sum(holds[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows


def some_texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(1, 60))) for _ in range(40)]
    made += ["", None, " ", "   ", "a ", "▁x y", "one <|endoftext|> two", "<s>a</s>", "x" * 300, "日" * 120, "a\u0000b", made[0], made[0], "  lead and trail  ", "don't stop's 'tis"]
    return made


@pytest.mark.parametrize("chunk", [1 << 16, 12])
def test_alignment_by_brute_force(spark, monkeypatch, chunk):
    texts = some_texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    got, pairs = al.aligned(df.select("*", df["text"].alias("block")), ("doc_id", "text"), chunk, fan=3)
    order = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    have = Counter((r["text"], *(r[c] for c in order)) for r in got.collect())
    assert have == Counter((t, *r) for t, r in zip(texts, brute(texts), strict=True))
    assert pairs.where("documents < 1").count() == 0


def test_compose_is_associative():
    rng = random.Random(2)
    np = al.np
    for _ in range(300):
        total = rng.randint(4, 40)
        ends = [np.array(sorted({*rng.sample(range(1, total), rng.randint(0, total - 1)), total}), np.int64) for _ in range(2)]
        at = [sorted(rng.choices(range(len(e) + 1), k=3)) for e in ends]
        parts, groups = [], []
        for k in range(4):
            tokens = []
            for e, cut in zip(ends, at, strict=True):
                lo, hi = [0, *cut][k], [*cut, len(e)][k]
                tokens += [np.arange(lo, hi), e[lo:hi]]
            f, g = al.settle(tokens, k == 0)
            parts.append(f)
            groups.append(g)

        def of(tree):
            if isinstance(tree, int):
                return parts[tree], [groups[tree]]
            (x, gx), (y, gy) = of(tree[0]), of(tree[1])
            f, g = al.compose(x, y)
            return f, [*gx, g, *gy]

        results = [of(t) for t in ((((0, 1), 2), 3), ((0, (1, 2)), 3), (0, ((1, 2), 3)), (0, (1, (2, 3))), ((0, 1), (2, 3)))]
        for f, gs in results:
            assert f.closed and not any(map(len, f.before)) and not any(map(len, f.after))
            taken = sorted(int(i) for g in gs for i in g[0])
            assert taken == list(range(len(ends[0])))


def test_empty_table(spark):
    got, pairs = al.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and pairs.count() == 0
