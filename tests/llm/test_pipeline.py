"""The five stages together against a plain brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline

SYLLABLES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
WORD = r"[^\x20\x09-\x0D]+"
#: The four base patterns, in their order.
BASE = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IP": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "CARD": r"[0-9](?:[\x20-]?[0-9])+",
    "PHONE": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SOURCES = ("a", "b", "c", None)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n))


def corpus():
    texts = {i: prose(i, 60 + 9 * i) for i in range(24)}
    for i in range(5):
        words = texts[i + 10].split()
        words[40] = "changed"
        texts[100 + i] = " ".join(words)
        texts[200 + i] = texts[i + 15].upper()
    texts |= {300: prose(300, 10), 301: "again and again " * 60, 302: None, 303: "", 304: prose(304, 6000)}
    texts[305] = prose(305, 80) + " mail a.b@c.de or call +1 (425) 555-9684 with 4111 1111 1111 1111 at 10.0.0.1 soon"
    return texts


def kept_by_rules(text):
    words = re.findall(WORD, text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


def without_copies(texts):
    sets = {}
    for i, text in texts.items():
        words = re.findall(WORD, text.lower())
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: text for i, text in texts.items() if root[i] == i}


def luhn(digits):
    odd, even = [int(d) for d in digits[-1::-2]], [int(d) * 2 for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def masked(text):
    found = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "EMAIL": True,
                "IP": all(int(p) <= 255 for p in m[0].split(".")) if name == "IP" else False,
                "CARD": 14 <= len(digits) <= 19 and luhn(digits),
                "PHONE": 10 <= len(digits) <= 15,
            }[name]
            if good:
                found.append((m.start(), kind, m.end(), name))
    out, at = "", 0
    for start, _, end, name in sorted(found):
        if start >= at:
            out += text[at:start] + f"[{name}]"
        at = max(at, end)
    return out + text[at:]


def repetition_rates(sizes):
    """Rate of each source, from (source, size) pairs."""
    total = defaultdict(int)
    for source, size in sizes:
        total[source] += size
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} or {s: level * weight[s] for s in open_}
        left, open_ = left - sum(2.0 * total[s] for s in full), open_ - full if full else set()
    return {s: target[s] / total[s] for s in order}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = corpus()
    rows = [(i, t, "en", SOURCES[i % 4], len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_agree_with_brute_force(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {i: masked(t) for i, t in without_copies({i: t for i, t in corpus().items() if kept_by_rules(t)}).items()}
    assert set(texts) == {*range(24), 304, 305} and "[EMAIL]" in texts[305] and "[CARD]" in texts[305]
    size = {i: len(re.findall(WORD, t)) for i, t in texts.items()}
    rate = repetition_rates([(SOURCES[i % 4], n) for i, n in size.items()])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}

    rows = corpus_pipeline.run(spark, tables).collect()
    copies = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    for i in texts:
        share = rate[SOURCES[i % 4]]
        assert copies[i] in {int(share + 1e-9), int(np.ceil(share - 1e-9))}
    assert set(copies) <= set(texts)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, found in pieces.items():
        expected = [(at, min(2048, tokens[i] - at)) for at in range(0, tokens[i], 2048)]
        assert sorted(found) == sorted(expected * copies[i])
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), tables).columns == docs.columns


def test_quality_stage_judges_rows_that_share_an_id_on_their_own(spark, tables):
    good, bad = prose(1, 80), "too short"
    docs = spark.createDataFrame([(7, good, "en", "a", 1), (7, bad, "en", "a", 1), (None, good, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, tables).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in kept) == [(False, good), (True, good)]
