"""Language scores and the whole pipeline against plain Python that works on all rows at once."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import tiktoken

import corpus_pipeline
from quarryspark.llm import language_id

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def scores(rows, longest=5, least=2):
    """{doc_id: (language, score)} of rows (doc_id, text, lang), learned from those that are not held out."""
    words = {}
    for i, text, lang in rows:
        if lang and text is not None and not held_out(i):
            words.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_]+", text.lower()))
    languages = sorted(words)
    grams = {name: Counter() for name in languages}
    for name, own in words.items():
        for word, c in own.items():
            marked = f"^{word}$"
            for n in range(1, min(longest, len(marked)) + 1):
                for k in range(len(marked) - n + 1):
                    grams[name][marked[k : k + n]] += c

    def logs(counts, least):
        every = Counter()
        for own in counts.values():
            every.update(own)
        keys = [k for k, c in every.items() if c >= least]
        below = {name: sum(counts[name][k] for k in keys) + 0.05 * max(1, len(keys)) for name in languages}
        return {k: [math.log((counts[name][k] + 0.05) / below[name]) for name in languages] for k in keys}

    known, parts, out = logs(words, least), logs(grams, 4 * least), {}
    for i, text, _ in rows:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        total = [0.0] * len(languages)
        for word in found:
            row, marked = known.get(word), f"^{word}$"
            for n in range(min(longest, len(marked)), 0, -1):
                if row is None and (hits := [parts[g] for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) in parts]):
                    row = [sum(x) / len(hits) for x in zip(*hits, strict=True)]
            total = [a + b for a, b in zip(total, row or [0.0] * len(languages), strict=True)]
        if not found or not languages:
            out[i] = ("und", 0.0)
            continue
        soft = [math.exp(10 * (t - max(total)) / len(found)) for t in total]
        out[i] = (languages[total.index(max(total))], max(soft) / sum(soft))
    return out


def random_texts(seed, n, alphabets, size):
    r = np.random.default_rng(seed)
    word = lambda letters: "".join(r.choice(list(letters), int(r.integers(1, 8))))
    names = sorted(alphabets)
    return [(k, " ".join(word(alphabets[names[k % len(names)]]) for _ in range(int(r.integers(1, size)))), names[k % len(names)]) for k in range(n)]


def test_language_scores_are_those_of_plain_python(spark):
    rows = random_texts(5, 240, {"xx": "abcdefgé", "yy": "efghijkl", "zz": "ijklmabß"}, 12)
    rows += [(300, None, "xx"), (301, "", "yy"), (302, "12 -- 34_", "zz"), (303, "QQQ qqq", None), (304, "漢字 abc", "xx"), (305, "Abc, DEF! abc", ""), (306, "x" * 40, None)]
    want = scores(rows)
    got = language_id.op7_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got}) == 4
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-4, r
        assert r["held_out"] == held_out(r["doc_id"])
    assert 0.34 < min(r["score"] for r in got if r["lang_pred"] != "und") < 0.6


def shingles(text):
    words = [w for w in BLANK.split("".join(c.lower() if c.isascii() else c for c in text)) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(texts):
    """The least id of each group of documents that links of four fifths hold together."""
    sets, top = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        return i if top[i] == i else root(top[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i for i in texts if root(i) == i}


def filled(given, children):
    """{name: budget} of children {name: (capacity, weight)}: full ones get what they hold, the rest share by weight."""
    live, out, rest = {n: c for n, c in children.items() if c[1] > 0}, {}, given
    while full := [n for n, (cap, w) in live.items() if cap * sum(x for _, x in live.values()) <= rest * w]:
        out[full[0]] = live.pop(full[0])[0]
        rest -= out[full[0]]
    upto, weight = 0, sum(w for _, w in live.values())
    for name in sorted(live):
        w = live[name][1]
        out[name] = rest * (upto + w) // weight - rest * upto // weight
        upto += w
    return out | {n: 0 for n, (_, w) in children.items() if w <= 0}


def mixture(rows, weights, share, seed=17):
    """The ids that one epoch takes of rows (doc_id, text, lang, source)."""
    leaves = {}
    for i, text, lang, source in rows:
        digits = re.search("([0-9]{1,9})$", source or "")
        leaf = (f"d{int(digits[1]) % 4 if digits else 0}", lang or "", source or "")
        leaves.setdefault(leaf, []).append((i, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    tokens = {leaf: sum(n for _, n in own) for leaf, own in leaves.items()}
    weigh = lambda depth, name: weights.get(("domain", "lang", "source")[depth], {}).get(name, 1)
    cap = {leaf: n if all(weigh(d, leaf[d]) > 0 for d in range(3)) else 0 for leaf, n in tokens.items()}
    budgets = {(): min(sum(tokens.values()) * share[0] // share[1], sum(cap.values()))}
    for depth in range(3):
        below = {}
        for parent, given in budgets.items():
            names = {leaf[depth] for leaf in leaves if leaf[:depth] == parent}
            children = {n: (sum(c for leaf, c in cap.items() if leaf[: depth + 1] == (*parent, n)), weigh(depth, n)) for n in names}
            below |= {(*parent, n): b for n, b in filled(given, children).items()}
        budgets = below
    taken = set()
    for leaf, own in leaves.items():
        if budgets[leaf] and budgets[leaf] == tokens[leaf]:
            taken |= {i for i, _ in own}
            continue
        total = 0
        for i, n in sorted(own, key=lambda x: (hashlib.md5(f"{seed}:1:{x[0]}".encode()).hexdigest(), x[0])):
            total += n
            if total <= budgets[leaf]:
                taken.add(i)
    return taken


def test_pipeline_is_that_of_plain_python(spark, tmp_path):
    """Ids, languages, mixture, token ids and hashes of run(), with copies, near copies, nulls and unsure rows planted."""
    r = np.random.default_rng(23)
    rows = []
    for i, text, lang in random_texts(7, 260, {"de": "abcdefgh", "en": "efghijkl", "fr": "klmnopqé"}, 60):
        rows.append([i, text, None if i % 19 == 0 else lang, None if i % 41 == 0 else f"src{int(r.integers(0, 7))}", 0])
    for k in range(300, 360):  # copies with other blanks, near copies, and chains of them
        own = rows[int(r.integers(0, 260))][1].split(" ")
        if k % 3:
            own = own + ["abc"] if k % 3 == 1 else own[1:]
        rows.append([k, ("  " if k % 2 else "\n").join(own) or None, "en", f"src{k % 7}", 0])
    long = [w for _, t, *_ in rows[:40] for w in (t or "").split()][:300]
    rows += [[400 + k, " ".join([*long, *["abc", "fgh", "kkl"][:k]]), "de", "src1", 0] for k in range(4)]
    rows += [[600 + i, text, None, "src3", 0] for i, text, _ in random_texts(9, 40, {"any": "wxyz"}, 3)]  # of letters that no language has
    rows += [[500, None, "en", "src1", 0], [501, "", None, None, 0], [502, "12 3", "de", "src2", 0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    found = scores([x[:3] for x in rows])
    assert min(abs(s - corpus_pipeline.LEAST_SURE) for _, s in found.values()) > 1e-4
    kept = [(i, text, found[i][0], source) for i, text, _, source, _ in rows if found[i][0] != "und" and found[i][1] >= corpus_pipeline.LEAST_SURE]
    assert 3 < len(rows) - len(kept) < len(rows) / 2
    first = {}
    for x in sorted(kept):
        first.setdefault(BLANK.sub(" ", x[1]), x)
    exact = list(first.values())
    near = first_of_groups({x[0]: x[1] for x in exact})
    assert len(exact) < len(kept) and len(near) < len(exact)
    apart = [x for x in exact if x[0] in near]
    taken = mixture(apart, corpus_pipeline.mixing.TABLE_WEIGHTS, (4, 5))
    assert 0 < len(taken) < len(apart)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(corpus_pipeline.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, text, lang, source in apart:
        if i in taken:
            ids = np.array(own.encode_ordinary(text), "<u4").tobytes()
            want.add((i, lang, source, ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["lang"], r["source"], bytes(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
