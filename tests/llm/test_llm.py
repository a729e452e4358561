"""The training-data operators against brute force and on edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensespark.llm import components, html, jaccard, media, mixing, packing, pii, quality, queries, sharding, toxicity, warc
from sensespark.llm.storage import work_dir

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, rep long, slot int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


@pytest.fixture(scope="module")
def docs(spark):
    near = prose(1, 300).split()
    near[150] = "changed"
    texts = [prose(1, 300), " ".join(near), prose(1, 300).upper(), prose(2, 200), "", None, "one two", "One  two\n", "x" * 30000, prose(3, 9000), "mail a.b@c.de now", "call +1 (425) 555-9684 or 4111 1111 1111 1111"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 0, 7, "k", 9, 3) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "en", "s1", 0, 7, "k", 9, 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_png_round_trip_and_damage():
    for data in (b"", b"a", prose(1, 500).encode(), bytes(range(256)) * 9):
        payload = media.pad(data)
        image = media.encode_png(payload)
        assert media.decode_png(image).tobytes() == payload
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(image[:40] + bytes([image[40] ^ 1]) + image[41:])


def test_png_filters_average_and_paeth():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (3, 5), dtype=np.uint8)
    for kind in (3, 4):
        raw, above = np.zeros((3, 6), np.uint8), np.zeros(5, int)
        for y in range(3):
            raw[y, 0] = kind
            for x in range(5):
                left, corner, up = (int(rows[y, x - 1]), int(above[x - 1])) if x else (0, 0), 0, int(above[x])
                left, corner = left
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                raw[y, x + 1] = (int(rows[y, x]) - guess) % 256
            above = rows[y].astype(int)
        assert np.array_equal(media._unfilter(raw, 5), rows)


def test_media_rows(spark, docs, empty):
    got = media.media_features(media.encode_media(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["id"] == 4:
            assert r["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest() and r["n_bytes"] == 0
    assert media.media_features(media.encode_media(empty)).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>only", "only"),
        ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p><b>A  b<br><p>C &amp; d, e</article><footer>f</footer>", "T\n\nA b\n\nC & d, e"),
        ("<div class='sidebar'><p>side, bar, words</p></div><div id=main><p>long text, with commas, and more</p></div><div id=comments><p>nice, one</p></div>", "long text, with commas, and more"),
        ("<article><p>a</p><script>var t='</p>';</script><form>x</form><div class=cookie-notice>ok</div><p>b</p></article>", "a\n\nb"),
        ("<article><p>x<!-- open <p>y", "x"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_mixing(spark, docs, empty):
    rows = mixing.mix_plan(docs).collect()
    size = {}
    for r in docs.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {r["source"]: r["source_size"] for r in rows} == size
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True))
    left, todo, target = 1.5 * sum(size.values()), set(size), {}
    while todo:
        full = [s for s in todo if left * weight[s] / sum(weight[t] for t in todo) >= 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in full} if full else {s: left * weight[s] / sum(weight[t] for t in todo) for s in todo}
        left, todo = left - sum(2 * size[s] for s in full), todo - set(full) if full else set()
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 and r["copies"] in (0, 1, 2) for r in rows)
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_sharding(spark, docs, empty):
    rows = sharding.assign_shards(docs, 3, slots=64).collect()
    assert len(rows) == docs.count()
    for shard in {r["shard"] for r in rows}:
        mine = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert mine == list(range(len(mine)))
    sizes = sharding.slot_bytes(sharding.records_of(docs, 64), 64)
    path = work_dir(spark) + "/maps-test"
    sharding.save_map(sharding.first_map(sizes, 3), path)
    sharding.save_map(sharding.balance_map(sharding.load_map(spark, path), 3), path)
    second = sharding.load_map(spark, path)
    assert {r["version"] for r in second.collect()} == {1} and sharding.load_map(spark, path, 0).count() == 64
    sharding.save_map(sharding.grow_map(second, 3), path)
    grown = sharding.load_map(spark, path).select("virtual_slot", F.col("shard").alias("now"), "version")
    moved = second.select("virtual_slot", "shard").join(grown, "virtual_slot").filter("shard <> now").collect()
    assert moved and all(r["now"] == 3 and r["version"] == 2 for r in moved)
    assert sharding.assign_shards(empty, 3).count() == 0


def test_first_fit_decreasing():
    lengths = np.random.default_rng(2).integers(1, 50, 400)
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    room, expected = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [64] * (b == len(room))
        expected[i] = (b, 64 - room[b])
        room[b] -= lengths[i]
    assert all((int(bins[i]), int(offsets[i])) == v for i, v in expected.items())


def test_packing_ids_are_those_of_tokenizers(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    text = "Hello  world's é 漢字 123\n\n <|endoftext|>  x"
    assert packing._tokenizer("byte_bpe_50k.json")(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    pieces = packing.token_pieces(docs, 128, with_ids=True)
    placed = packing.pack(pieces, 128)
    rows = placed.collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    whole = {(r["doc_id"], r["start"]): r["ids"] for r in pieces.collect()}
    mine = placed.filter("doc_id = 9")
    built = {r["sequence_id"]: r["ids"] for r in packing.build_sequences(pieces, mine).collect()}
    for r in mine.collect():
        assert built[r["sequence_id"]] == whole[9, r["start"]]
    assert packing.pack_documents(empty).count() == 0


def test_packing_ids_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    texts = [f"a {e} b", e, e + e, f"  {e}\n\n{e}  x", f"it's{e}'s 12{e}34 é", f"<|endoftext {e}|>", f"<{e}", "<|ENDOFTEXT|>", "plain  text\n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in packing.token_pieces(df, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert rows[i]["ids"] == ids.tobytes(), text
        assert (rows[i]["doc_tokens"], rows[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert np.frombuffer(rows[0]["ids"], "<u4").tolist() == [64, 220, 50256, 275, 1]


def test_personal_data(spark, docs, empty):
    rows = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).select("doc_id", pii.written(F.col("spans")).alias("spans")).collect()}
    assert rows[10] == "email:5:13" and rows[11] == "phone:5:22,card:26:45"
    assert pii.redact(docs).filter("doc_id = 10").first()["text"] == "mail [EMAIL] now"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    assert pii.find_spans(empty).count() == 0 and pii.redact(empty).count() == 0


def test_address_parts(spark):
    parts = ["0", "00", "7", "007", "10", "99", "100", "199", "200", "249", "250", "255", "0255", "256", "260", "300", "999", "0256", "1000"]
    df = spark.createDataFrame([(p, f"at 10.0.0.{p} or {p}.0.20.1") for p in parts], "part string, text string")
    for r in df.select("part", F.size(pii.base_spans(F.col("text"))).alias("n")).collect():
        assert r["n"] == (2 if int(r["part"]) <= 255 else 0), r["part"]


def test_context_discovers_unseen_identifiers(spark):
    texts = [f"please write to: u{i}@mail.example for more" for i in range(30)] + ["please write to: member7781 for more"] + ["we walk to the house 123456"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert rows[30] == "context:17:27" and rows[31] == ""


def test_slots_after_line_ends_and_tabs(spark):
    gaps = ["\n", "\t", "\r\n"]
    texts = [f"please write to:{g}u{i}@mail.example for more" for g in gaps for i in range(6)] + [f"please write to:{g}member7781 for more" for g in gaps]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert [rows[18 + k] for k in range(3)] == ["context:17:27", "context:17:27", "context:18:28"]


def test_slots_after_any_white_space_and_long_words(spark):
    gaps = ["\n", "\t", "\r\n", "\x0b", "  \n\t ", " " * 200]
    heads = [("write", "to:"), ("https://example.org/" + "p" * 120, "mail:"), ("先" * 90, "至" * 70)]
    texts = [f"x {a}{g}{b}{g}u{i}@mail.example end" for a, b in heads for g in gaps for i in range(6)]
    unseen = [f"x {a}{g}{b}{g}member7781 end" for a, b in heads for g in gaps]
    # A place that ends like the second long pair is not credited to that pair.
    other = [f"x {'p' * 50} mail: member7781 end"]
    df = spark.createDataFrame(list(enumerate(texts + unseen + other)), "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    for i, text in enumerate(texts):
        at = text.index("u" + text.split("@")[0].rsplit("u", 1)[1] + "@")
        assert rows[i] == f"email:{at}:{text.index(' end')}", text
    for i, text in enumerate(unseen, len(texts)):
        at = text.index("member7781")
        assert rows[i] == f"context:{at}:{at + 10}", text
    assert rows[len(texts) + len(unseen)] == ""


LEAD = r"(?:[^\W\d_]|_)(?:[^\W\d_]|[_-])*[=:][\"']?(?=[^\W\d_]|[0-9+@])|(?:(?![^\W\d_]|[0-9+@]).)*"


def before_words(text):
    """Start of what a word holds behind its key or punctuation: what stands before it."""
    words = [(m.start(), m.group(), re.sub("[0-9]", "0", m.group().lower())) for m in re.finditer(r"[^ \t-\r]+", text)]
    out = {}
    for i, (at, raw, _) in enumerate(words):
        lead = re.match(LEAD, raw).group()
        pair = " ".join(w[2] for w in words[max(0, i - 2) : i])
        if lead and (lead[0].isalpha() or lead[0] == "_"):
            out[at + len(lead)] = lead.lower()
        elif i >= 2:
            out[at + len(lead)] = pair + " " * bool(lead) + lead
    return out


def test_slots_have_what_stands_before_them(spark):
    rng = np.random.default_rng(9)
    tokens = ["mail", "to", "a.b@c.de", "x7", "id=4471", 'key="ab12cd34"', "(ab123)", "Ünï", "10.0.0.1", "+1 (425) 555-9684", "4111 1111 1111 1111", "w" * 100, "9"]
    texts = ["".join(str(t) + str(g) for t, g in zip(rng.choice(tokens, n), rng.choice([" ", "\n", "\t", "\r\n", "   "], n))) for n in rng.integers(1, 40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("text", pii.base_spans(F.col("text")).alias("base"), pii._slots(F.col("text"), pii.base_spans(F.col("text"))).alias("slots")).collect()
    for r in got:
        before = before_words(r["text"])
        assert all(s["pattern"] == before[s["start"]] for s in r["slots"])
        assert [s["start"] for s in r["slots"] if s["seed"]] == [b["start"] for b in r["base"] if b["start"] in before]


def test_totals_are_all_occurrences(spark):
    rng = np.random.default_rng(3)
    tokens = ["mail", "to", 'x="', '"q1', "id=4471", "id=word", "(to", "ß"]
    texts = [" ".join(rng.choice(tokens, n).tolist()) for n in rng.integers(0, 30, 50)] + [None, ""]
    want = {}
    for t in texts:
        words = re.sub("[0-9]", "0", (t or "").lower()).split()
        for i, w in enumerate(words):
            lead, pair = re.match(LEAD, w).group(), [" ".join(words[i - 2 : i])] * (i >= 2)
            for p in pair + ([lead] if lead[:1].isalpha() else [f"{x} {lead}" for x in pair if lead]):
                want[p] = want.get(p, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    wanted = spark.createDataFrame([(p, 10**6) for p in [*want, "no such"]], "pattern string, most long")
    assert {r["pattern"]: r["total"] for r in pii._totals(df, wanted).collect()} == want
    few = spark.createDataFrame([(p, 0) for p in want], "pattern string, most long")
    left = {r["pattern"]: r["total"] for r in pii._totals(df, few).collect()}
    assert all(want[p] == n for p, n in left.items()) and len(left) < len(want)


def test_counts_are_not_joined_before_they_are_made(spark):
    df = spark.createDataFrame([("a b c",)] * 5, "text string")
    plan = pii._occurrences(df, spark.createDataFrame([("a b",)], "pattern string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Generate" not in plan


def test_credentials_behind_keys(spark):
    rng = np.random.default_rng(8)
    secret = lambda n: "".join(rng.choice(list("0123456789abcdef"), n)) + "a1"
    texts = [f'some words token = "{secret(38)}" and more' for _ in range(8)] + [f"set password={secret(18)} now" for _ in range(8)]
    texts += ['some words token = "short77" and more', "set password=hunter22 now", "other words 1234567 and more", f"a lone {secret(20)} here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert [rows[i] for i in (0, 8, 16, 17, 18, 19)] == ["context:20:60", "context:13:33", "context:20:27", "context:13:21", "", ""]


def test_rows_that_share_an_id_keep_their_own_spans(spark):
    texts = [f"please write to: u{i}@mail.example for more" for i in range(8)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(99, "please write to: member7781 for more", 1), (99, "ABCDEFGHIJKLMNOPQRSTUVWXYZ 7 abc", 2), (None, "please write to: member7781 for more", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = {r["row"]: r["text"] for r in pii.redact(df).filter("doc_id = 99 or doc_id is null").collect()}
    assert got == {1: "please write to: [CONTEXT] for more", 2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ 7 abc", 3: "please write to: [CONTEXT] for more"}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return {"ip": lambda: all(int(p) <= 255 for p in match.split(".")), "phone": lambda: 10 <= len(digits) <= 15, "email": lambda: True}[kind]()


def test_personal_data_query_agrees_with_brute_force(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op6_contextual_pii(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, d["text"] or "") if valid(kind, m[0]))
        r, base = got[d["doc_id"]], [f"{kind}:{a}:{b}" for a, _, kind, b in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in BASE] == [sum(x.startswith(kind) for x in base) for kind in BASE]
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def brute_links(texts):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = {d: min(ra, rb) if r in (ra, rb) else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_links_agree_with_brute_force(spark):
    rng, texts = np.random.default_rng(4), []
    for g in range(12):
        base = prose(100 + g, int(rng.integers(4, 250))).split()
        for _ in range(int(rng.integers(1, 8))):
            copy = [w if rng.random() > 0.015 else "new" for w in base]
            texts.append((len(texts), " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for tile, crowd in ((2048, 256), (3, 1), (3, 256)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(df, tile=tile, crowd=crowd).collect()}
        assert got == brute_links(texts)


def test_links_on_edge_cases(spark, docs, empty):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs).collect()]
    first = len(jaccard.shingles(prose(1, 300)))
    assert len(rows) == docs.count() and [r for r in rows if r[0] is None] == [(None, first, 0)]
    by = {a: c for a, _, c in rows}
    assert by[1] == by[2] == by[0] == 0 and by[4] == 4 and by[5] == 5 and by[7] == 6
    assert jaccard.link_documents(empty).count() == 0
    assert jaccard.keep_first(docs).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 1000):
        got = {r["id"]: r["component"] for r in components.connected_components(df, few=few).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
        assert components.connected_components(df.limit(0), few=few).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = [(i, prose(i, 40) + (" worthless trash" if i % 2 else ""), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitted = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, fitted).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(200))
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.95
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    assert toxicity.score_documents(empty, none).count() == 0


def test_quality_statistics_and_cutoffs(spark, docs, empty):
    for r in quality.statistics(docs).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        windows = list(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 1000 else None
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert covered is None or r["n_repeat_words"] == len(covered)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality.judge_documents(docs, labels)
    assert judged.count() == docs.count() and judged.filter("kept and base_failed").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge_documents(empty, labels).count() == 0


def test_cutoffs_are_the_strictest_that_the_exact_bound_allows(spark):
    from math import comb

    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        words = [f"w{k}" for k in rng.permutation(60)]
        marks = 0 if rng.random() < 0.985 else int(rng.integers(1, 40))
        words[:marks] = [w + "#" for w in words[:marks]]
        good = int(rng.random() < 0.9)
        rows.append((i, " ".join(w + "##" * (1 - good) for w in words), "small" if i % 5 == 0 and i < 600 else "large", good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = docs.select("doc_id", "quality")
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.learn_cutoffs(quality.statistics(docs), labels).collect()}
    stats = quality.statistics(docs).join(labels, "doc_id").filter("quality = 1")
    stats = stats.withColumns(quality.rule_values()).withColumn("part", F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(4)) == 0).toPandas()
    for lang, mine in stats.groupby("stratum"):
        propose, hold = mine[mine["part"]], mine[~mine["part"]]
        base = {r: next((i for i, c in enumerate(cuts) if (propose[r] > c).sum() <= 0.002 * len(propose)), len(cuts)) for r, cuts in quality.RULES.items()}
        expected = {}
        for j in range(9, -1, -1):
            cuts = {r: quality.RULES[r][base[r] + j] for r in quality.RULES if base[r] + j < 10}
            k, n = sum(any(row[r] > c for r, c in cuts.items()) for _, row in hold.iterrows()), len(hold)
            if sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) > 0.025:
                break
            expected = cuts
        assert {r: c for (s, r), c in found.items() if s == lang} == expected
        assert bool(expected) == (lang == "large")
    verdict = quality.judge_documents(docs, labels).join(labels, "doc_id").filter("not base_failed and stratum = 'large'")
    assert {r["kept"] for r in verdict.filter("quality = 0").collect()} == {False}
    assert verdict.filter("quality = 1 and not kept").count() <= 0.02 * verdict.filter("quality = 1").count()


def test_binomial_bound(spark):
    from math import comb

    cases = [(k, n) for n in (50, 300, 900) for k in (0, 1, 3, 8)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = {(r["k"], r["n"]): r["ok"] for r in df.select("k", "n", quality.surely_below(F.col("k"), F.col("n"), 0.03, F.lit(0.01)).alias("ok")).collect()}
    for k, n in cases:
        assert got[k, n] == (sum(comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1)) <= 0.01)


def test_archives(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (5, "x", ""), (7, "y", "é" * 5000), (None, "z", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, records int")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    assert got[1]["record_type"] == "response" and got[3]["refers_to"] == 1 and got[None]["refers_to"] == 1
    assert got[5]["refers_to"] == 2 and got[2]["payload_bytes"] == 0 and got[7]["payload_bytes"] == 10000
    assert got[7]["payload_digest"] == warc.payload_digest(("é" * 5000).encode())
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_have_a_member_per_record_and_are_read_by_the_sidecar(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 7}</p>" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    raw, members = str(tmp_path / "raw"), str(tmp_path / "members")
    archives = warc.write_archives(pages, raw)
    normal = warc.normalise(archives, raw, members)
    (old,), (new,) = archives.collect(), normal.collect()
    data = open(f"{raw}/{old['path']}", "rb").read()
    unzip = zlib.decompressobj(31)
    whole = unzip.decompress(data) + unzip.flush()
    assert unzip.eof and not unzip.unused_data
    data, parts = open(f"{members}/{new['path']}", "rb").read(), []
    lines = [tuple(map(int, x.split())) for x in open(f"{members}/{new['path']}.idx").read().splitlines()]
    for at, n in lines:
        parts.append(zlib.decompress(data[at : at + n], 31))
    assert len(parts) == 30 == new["records"] and b"".join(parts) == whole and sum(n for _, n in lines) == len(data)
    assert warc.read_archives(normal, members).count() == 30
    with open(f"{members}/{new['path']}.idx", "w") as f:
        f.writelines(f"{a} {n}\n" for a, n in lines[:-1])
    with pytest.raises(Exception, match="29 of 30 records"):
        warc.read_archives(normal, members).collect()


def test_archive_query_agrees_with_brute_force(spark):
    import base64

    pages = spark.read.parquet(DATA + "/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"] or "", p["page_id"])
    want = {}
    for p in pages:
        data, owner = (p["html"] or "").encode(), first[p["html"] or ""]
        own = owner == p["page_id"]
        want[p["page_id"]] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else owner)
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op10_warc_normaliser(spark, DATA).collect()}
    assert got == want


def test_media_query_agrees_with_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    rows = queries.op1_media_columns(spark, DATA).collect()
    stored = {r["id"]: r["media"] for r in media.encode_media(spark.read.parquet(DATA + "/documents.parquet")).collect()}
    basis = np.array([[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)])
    assert len(rows) == len(docs) and basis.shape == (8, 32)
    by_text = {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        payload = data + b" " * ((-len(data)) % 192 or (192 if not data else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        image = bytes(stored[r["doc_id"]])
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        at, body = 8, b""
        while at < len(image):
            n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
            assert zlib.crc32(image[at + 4 : at + 8 + n]) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
            body += image[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        assert len(zlib.decompress(body)) == len(payload) // 192 * 193
        assert by_text.setdefault(docs[r["doc_id"]], r["feature"]) == r["feature"]
    assert len(set(by_text.values())) > len(by_text) / 2


def test_sharding_query_agrees_with_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    rows, shards = queries.op4_slot_sharding(spark, DATA).collect(), {}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"bytes"}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and 0 <= r["shard"] < 40 and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in shards.values())


def test_shards_hold_near_equal_bytes(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pmod(xxhash64(id), 900) as int))").alias("text"))
    docs = docs.unionByName(spark.range(10_000).select((F.col("id") + 20_000).alias("doc_id"), F.lit("the same text for a third of all").alias("text")))
    loads = [r["b"] for r in sharding.assign_shards(docs, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 40 and max(loads) < 1.05 * min(loads)


def test_packing_query_agrees_with_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    pieces, sequences = {}, {}
    for r in queries.op5_packing(spark, DATA).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, found in pieces.items():
        ids = np.array([*t.encode(docs[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends <= 2048


def test_quality_query_agrees_with_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    for r in queries.op9_quality_rules(spark, DATA).collect():
        text = docs[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = {}
        for x in windows:
            often[x] = often.get(x, 0) + 1
        repeated = len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated)
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_extract_text_on_edge_cases(spark):
    page = "<article><p>One, two &lt; three</p><p>four</p></article>"
    rows = [(1, "u", page, 9, "t"), (1, "u", page, 9, "t"), (None, None, page, 9, "t"), (3, "v", None, 9, "t"), (4, "w", "<p>" + "long, " * 100_000, 9, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html.extract_text(pages).collect()
    whole = "One, two < three\n\nfour"
    assert sorted((r["page_id"] or 0, r["text"][:40], r["n_chars"]) for r in got) == sorted(
        [(1, whole, 22), (1, whole, 22), (0, whole, 22), (3, "", 0), (4, ("long, " * 7)[:40], 599_999)]
    )
    assert html.extract_text(pages.limit(0)).count() == 0 and html.extract_text(pages).columns == ["page_id", "url", "text", "n_chars"]


def brute_grams(text):
    plain = f" {' '.join(text.lower().split())} "
    return {plain[i : i + n] for n in toxicity.SIZES for i in range(len(plain) - n + 1)} if text.split() else set()


def test_grams_are_of_characters():
    for text in ("", "  ", "a", "Ünï 漢字 \U0001f600 x", prose(3, 200)):
        grams = brute_grams(text)
        alone = {g: toxicity.gram_ids(text) for g in [text]}[text]
        assert len(set(alone.tolist())) <= len(grams) and (len(alone) == 0) == (not grams)
        assert len(set(alone.tolist())) >= 0.99 * len(grams)


def test_toxicity_fit_sees_numbers_and_not_texts(spark):
    docs = spark.createDataFrame([(i, ("awful " if i % 2 else "fine ") * 50_000 if i < 4 else prose(i, 30) + " awful" * (i % 2), i % 2) for i in range(80)], "doc_id long, text string, toxic int")
    weight, _ = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), features=64)
    assert 0 < np.count_nonzero(weight) <= 64


def test_workers_hand_memory_back_behind_their_last_batch(spark, monkeypatch):
    from sensespark.llm import storage

    seen = []
    monkeypatch.setattr(storage, "_release", lambda: seen.append("released"))
    work = storage.handing_back(lambda batches: (seen.append(b) or b for b in batches))
    assert list(work(iter([1, 2]))) == [1, 2] and seen == [1, 2, "released"]
    monkeypatch.undo()
    assert list(storage.handing_back(iter)([])) == []
    df = spark.range(100, numPartitions=3)
    assert sorted(r[0] for r in df.mapInArrow(storage.handing_back(lambda batches: batches), "id long").collect()) == list(range(100))


def test_idle_workers_forget_and_batches_are_short(spark, monkeypatch):
    """An idle worker kept its tokenizer and all pre-tokens, beside the next stage; batches had 10,000 whole texts."""
    import time

    from sensespark.llm import storage

    monkeypatch.setattr(storage, "IDLE", 0.2)
    seen = []
    work = storage.handing_back(lambda batches: batches, lambda: seen.append("forgot"))
    for _ in range(3):
        assert list(work(iter([1]))) == [1] and not seen
    time.sleep(0.6)
    assert seen == ["forgot"]
    assert packing._document_tokenizer("byte_bpe_50k.json")("a b") and packing._tokenizer.cache_info().currsize
    packing._forget()
    assert not packing._tokenizer.cache_info().currsize and not packing._document_tokenizer.cache_info().currsize
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, held = spark.conf.get(key), []
    write = storage.materialise
    for module in (packing, jaccard):
        monkeypatch.setattr(module, "materialise", lambda df, name: (held.append((name, int(spark.conf.get(key)))), write(df, name))[1])
    docs = spark.createDataFrame([(i, prose(i // 2, 30)) for i in range(8)], "doc_id long, text string")
    packing.pack_documents(docs).count()
    jaccard.link_documents(docs).count()
    short = {name for name, n in held if n <= storage.BATCH}
    assert {"pieces", "shingle-signs", "near-candidates", "near-links"} <= short and spark.conf.get(key) == before
