"""Toxicity, language ID and the whole pipeline against plain versions that share only the fitted models."""

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from textsluice.llm import langid, toxicity
from textsluice.llm.common import read_table
from textsluice.llm.queries import QUERIES
from textsluice.llm.tokens import default_tokenizer

from test_dedup_and_joins import corpus, docs
from test_models_and_search import speech

SF = "/root/testdata/sf0.01"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def crc_of(value):
    return zlib.crc32(str(value).encode())


# --- Toxicity --------------------------------------------------------------------------------


def plain_toxicity(machine, text):
    """The factorization machine's probability, pair by pair."""
    found = set()
    for word in SPACE.split(text or ""):
        w = "".join(c for c in unicodedata.normalize("NFKC", word).lower() if c.isalpha())
        pieces = [f"={w}"] if w else []
        pieces += [f"^{w[:n]}" for n in range(3, 7) if len(w) >= n] + [f"${w[-n:]}" for n in (4, 5) if len(w) >= n]
        found |= {zlib.crc32(p.encode()) // 2**10 for p in pieces}
    cols = sorted(int(machine.keep[t]) for t in found if machine.keep[t] >= 0)
    z = machine.bias + sum(float(machine.w[c]) for c in cols)
    for i, a in enumerate(cols):
        z += sum(float(x) for x in (machine.v[cols[i + 1 :]] @ machine.v[a]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_match_the_plain_machine(spark):
    table = read_table(spark, SF, "documents")
    machine = toxicity.fit(table, read_table(spark, SF, "labels"), langid.id_bucket("doc_id", 3) != 1)
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert got.keys() == texts.keys() and len(machine.w) > 0
    for i, text in texts.items():
        want = plain_toxicity(machine, text)
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (crc_of(i) % 3 == 1)
    rows = [(1, None), (2, ""), (3, "kaligro " * 30_000), (4, "ﬀ Ünïcode\x0bword"), (4, "ﬀ Ünïcode\x0bword")]
    odd = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), machine)
    assert Counter((r.doc_id, round(r.score, 9)) for r in odd.collect()) == Counter((i, round(plain_toxicity(machine, t), 9)) for i, t in rows)


# --- Language ID -----------------------------------------------------------------------------


def plain_language(model, text):
    """(language, cosine, rejected) from the model's IDF and centroids, n-gram by n-gram."""
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0, True
    b = [c if c >= 128 or ord("a") <= c <= ord("z") else 32 for c in text.lower().encode()]
    grams = Counter()
    for i in range(len(b) - 1):
        if (b[i], b[i + 1]) != (32, 32):
            grams[((b[i] * 256 + b[i + 1]) * 0x9E3779B1 % 2**32) >> 20] += 1
        if i + 2 < len(b) and (b[i], b[i + 1]) != (32, 32) and (b[i + 1], b[i + 2]) != (32, 32):
            grams[(((b[i] * 256 + b[i + 1]) * 256 + b[i + 2]) * 0x85EBCA6B % 2**32 >> 20) + langid.HALF] += 1
    x = {g: math.sqrt(n) * float(model.idf[g]) for g, n in grams.items()}
    length = math.sqrt(sum(v * v for v in x.values())) or 1.0
    cosines = [sum(v * float(model.centroids[g, k]) for g, v in x.items()) / length for k in range(len(model.languages))]
    best = max(range(len(cosines)), key=lambda k: cosines[k])
    return model.languages[best], min(1.0, max(0.0, cosines[best])), cosines[best] < model.floor[best]


def test_languages_match_plain_cosines(spark):
    table = read_table(spark, SF, "documents")
    model = langid.fit(table, langid.id_bucket("doc_id", 4) != 2)
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op3_language"](spark, SF).collect()}
    assert got.keys() == texts.keys() and len(set(model.languages)) > 1
    for i, text in texts.items():
        lang, cosine, rejected = plain_language(model, text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(cosine, abs=1e-5)
        assert got[i].rejected == rejected and got[i].held_out == (crc_of(i) % 4 == 2)


# --- Pipeline --------------------------------------------------------------------------------


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r["text"])].append(r)
    return [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]


def shingles(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return [r for r in rows if least[r["doc_id"]] == r["doc_id"]]


def plain_mix(rows):
    """Documents with their repetitions: water-filling by rounds, then each source in its seeded order."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((hashlib.md5(f"mix|{r['doc_id']}".encode()).hexdigest()[:12], r, len([w for w in SPACE.split(r["text"]) if w])))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, _, n in sources[s]) for s in names}
    weight, target, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while open_:
        left = sum(size.values()) - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        target.update({s: 3 * size[s] for s in over} if over else share)
        open_ = open_ - over if over else set()
    out = []
    for s in names:
        whole = min(3, int(target[s] / size[s])) if size[s] else 0
        want, before = target[s] - whole * size[s], 0
        for _, r, n in sorted(sources[s], key=lambda x: (x[0], x[1]["doc_id"])):
            extra = whole < 3 and want > 0 and before + Fraction(n, 2) <= want
            out += [r] * (whole + extra)
            before += n
    return out


def test_pipeline_matches_a_plain_chain(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(5)
    made = [(i, t and t + " " + speech(rng, ["tho", "er", "ing"], 3), "en", s, 0) for i, t, _, s, _ in corpus(80, seed=9)]
    most = max(r[0] for r in made)
    long = next(r[1] for r in made if r[1] and len(r[1]) > 200)
    made += [(most + 1, long + " ending", "en", "a", 0), (most + 2, long.replace(" ", "\n"), "en", "b", 0), (most + 3, "12 34", None, "a", 0), (most + 4, "", "en", None, 0), (most + 5, long * 40, "en", None, 0)]
    table = docs(spark, made)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), langid.id_bucket("doc_id", 4) != 2)
    rows = [dict(zip(("doc_id", "text", "lang", "source"), r[:4], strict=True)) for r in made]
    stages = [[r for r in rows if not plain_language(model, r["text"])[2]]]
    for step in (plain_exact, plain_near, plain_mix):
        stages.append(step(stages[-1]))
    assert len(rows) > len(stages[0]) > len(stages[1]) > len(stages[2]) > 10
    encoder = Tokenizer.from_file(str(default_tokenizer()))
    ids = {r["doc_id"]: [*encoder.encode(r["text"], add_special_tokens=False).ids, 1] for r in stages[2]}

    kept = table
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], stages, strict=True):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r["doc_id"] for r in want), name

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    count, covered, sequences = Counter(r["doc_id"] for r in stages[3]), Counter(), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(own) == p.length > 0
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        covered.update((p.doc_id, p.start + k) for k in range(p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == Counter({(d, k): n for d, n in count.items() for k in range(len(ids[d]))})
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(spans[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert sorted(sequences) == list(range(len(sequences)))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
