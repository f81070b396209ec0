"""Token alignment, quality rules and collocations: edge rows and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, collocations, quality_rules, queries

PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


# ---- alignment


class Plain:
    """Both libraries on whole texts, and links by comparing all ends."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(queries.tokenizer_path(PATHS[0]))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=queries.tokenizer_path(PATHS[1]))
        self.back = alignment.bytes_of_byte_level()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute_alignment(texts):
    """doc -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    plain, links, shown = Plain(), {}, {}
    for d, t in texts.items():
        a, b = plain.tokens(t)
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
        links[d] = [(a[i][0], b[j][0]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e == f] if len(a) < 500 else [(a[ends[0].index(e)][0], b[ends[1].index(e)][0]) for e in sorted({*ends[0]} & {*ends[1]})]
        groups, la, lb = [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            i, j = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(str(x) for x, _ in a[la:i]) + "|" + ",".join(str(x) for x, _ in b[lb:j]))
            la, lb = i, j
        shown[d] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
    count = Counter(x for ls in links.values() for x in ls)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return {d: (*shown[d][:3], len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), shown[d][3]) for d, ls in links.items()}


TRICKY = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a \n b", "a\n\n  b ", "\n", "\t x", "x\t", "don't I'VE it's", "naïve straße", "日本語 テキスト", "🙂🙂 ok", "<|endoftext|> and <s> </s> <0x0A>", "a▁b c", "x y  z", "é café",
    "\x00\x01 ctl", "a\x1c b\x1d  c", "z" * 3000, "word " * 700, "one two,three.\nFour five\r\nsix", "　 wide", "trailing\n ", "  \n  ", "12345 6,7  89",
]


def test_alignment_equals_both_libraries_on_whole_texts(spark, sf, monkeypatch):
    r = random.Random(3)
    mixed = ["".join(r.choice(["the ", "of", "tion", " ", "  ", "\n", ".", "é", "日", "\t", "x", "'s", " 12", " "]) for _ in range(r.randrange(40))) for _ in range(150)]
    given = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()
    texts = dict(enumerate([*TRICKY, *mixed, *[x.text for x in given], *TRICKY[:12]]))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts.items()], "doc_id long, text string, run long, part string, n_a int").repartition(3)
    monkeypatch.setattr(alignment, "FRAME", 7)
    rows = alignment.align_tokens(df, *map(queries.tokenizer_path, PATHS)).collect()
    want = brute_alignment(texts)
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) == want[x.doc_id], repr(texts[x.doc_id])


def test_alignment_of_runs_null_keys_and_empty_tables(spark):
    kind = "doc_id long, text string"
    assert alignment.align_tokens(spark.createDataFrame([], kind), *map(queries.tokenizer_path, PATHS)).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, None)], kind).repartition(4)
    got = alignment.align_tokens(df, *map(queries.tokenizer_path, PATHS)).collect()
    assert sorted((str(x.doc_id), x.n_links, x.n_best, x.count_sum) for x in got) == [("7", 0, 0, 0), ("7", 2, 2, 6), ("None", 2, 2, 6), ("None", 2, 2, 6)]


def test_merged_counts_are_those_of_all_runs_in_small_frames(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 3)
    r = random.Random(5)
    runs = [Counter({r.randrange(60): r.randrange(1, 5) for _ in range(r.randrange(25))}) for _ in range(6)]
    every, width = sum(runs, Counter()), 7
    most = {s: max(n for c, n in every.items() if c // width == s) for s in {c // width for c in every}}
    import numpy as np

    sent = [alignment.frames(np.array(sorted(x)), np.array([x[c] for c in sorted(x)])) for x in runs]
    for run, back in zip(runs, alignment.count_pairs(sent, width), strict=True):
        got = np.concatenate([alignment.unpack(f, 2) for f in back], axis=1).T.tolist() if back else []
        assert got == [[every[c], int(every[c] == most[c // width])] for c in sorted(run)]


# ---- quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


TEXTS = [None, "", " \n\t ", "a b c d e f", "a a a a a a a", "x y z u v x y z u v x", "ab\ncd\nab\n\n\ncd\nab\r\n", "é日🙂 #*$ <a|b>", "w " * 4000, "\x0b\x0c", "a b c d e a b c d e " * 3 + "f"]


def test_counts_equal_brute_force():
    r = random.Random(1)
    made = ["".join(r.choice(["a ", "b ", "c\n", "d\n", "é\t", "#", " "]) for _ in range(r.randrange(60))) for _ in range(300)]
    for t in TEXTS + made:
        assert quality_rules.counts_of((t or "").encode())[:5] == brute_counts(t), repr(t)


def test_bounds_are_exact():
    from fractions import Fraction
    from math import comb

    for n, p, error in ((50, Fraction(1, 10), Fraction(1, 20)), (700, Fraction(1, 100), Fraction(1, 400)), (30, Fraction(1, 100), Fraction(1, 400)), (300, Fraction(1, 5), Fraction(1, 1000))):
        tail, best = Fraction(0), -1
        for k in range(n + 1):
            tail += comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail > error:
                break
            best = k
        assert quality_rules.most_rejected(n, float(p), float(error)) == best
    assert quality_rules.most_rejected(0, 0.01, 0.01) == -1
    assert quality_rules.most_rejected(10**8, 0.01, 0.0025) < 10**6


def rule_docs(n=1600):
    """Good documents of plain words, of which 1 in 100 has many symbols, and bad ones full of symbols."""
    plain = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    rows = [(i, plain(i) + (" ###" if i % 100 == 0 else ""), "en") for i in range(n)]
    rows += [(n + i, plain(i) + " " + "#*" * 60, "en") for i in range(50)] + [(2 * n + i, plain(i) + " " + "#*" * 60, "fr") for i in range(50)]
    labels = [(i, int(i < n), 0) for i in range(n + 50)] + [(2 * n + 1, 1, 0)]
    return rows, labels


def test_thresholds_reject_junk_and_keep_good_documents(spark):
    rows, labels = rule_docs()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, n_words long, stratum string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    n = 1600
    assert len(got) == len(rows)
    assert not any(got[n + i].kept for i in range(50)) and got[n].rejected_by[0] == "symbols"
    assert all(got[2 * n + i].kept for i in range(50)), "a stratum without enough labels rejects nothing"
    assert sum(not got[i].kept for i in range(n)) <= 0.05 * n


def test_holdouts_bound_false_rejection_on_other_documents(spark):
    """Half of the good documents decide; of the other half no more than the bound is rejected in a stratum."""
    r = random.Random(11)
    one = lambda: " ".join("a" * r.randrange(2, 9) + str(r.randrange(10**6)) for _ in range(20)) + " " + "#" * min(40, int(r.expovariate(0.4)))
    docs = spark.createDataFrame([(i, one(), "en" if i % 3 else "de") for i in range(6000)], "doc_id long, text string, lang string")
    labels = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"))
    shares = quality_rules.judge(docs, labels).where("doc_id % 2 = 1").groupBy("stratum").agg(F.avg((~F.col("kept")).cast("int")).alias("gone")).collect()
    assert len(shares) == 2 and all(0 < s.gone <= 0.05 for s in shares)


def test_rules_on_edge_rows(spark):
    kind, labels = "doc_id long, text string, lang string", "doc_id long, quality int"
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "some text", "en"), (3, "a b c d e f", "en")], kind)
    for known in ([], [(3, 1), (3, 0), (None, 1), (None, None)]):
        got = quality_rules.judge(df, spark.createDataFrame(known, labels)).collect()
        assert len(got) == len(TEXTS) + 2
        assert all(x.kept != x.base_failed for x in got)
        for x in got:
            if x.doc_id is not None and x.stratum == "und":
                assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(TEXTS[x.doc_id])
    assert quality_rules.judge(spark.createDataFrame([], kind), spark.createDataFrame([], labels)).collect() == []


def test_quality_rules_equal_their_sql(spark, sf):
    assert_same(queries.op12_quality_rules(spark, sf), connect(sf), queries.ORACLE_SQL["op12_quality_rules"])


def test_quality_sql_finds_the_same_thresholds(spark, tmp_path):
    rows, labels = rule_docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op12_quality_rules(spark, str(tmp_path))
    assert got.where("not kept and not base_failed").count() >= 50
    assert_same(got, connect(str(tmp_path)), queries.ORACLE_SQL["op12_quality_rules"])


# ---- collocations


def brute_collocations(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang, low = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs():
    r = random.Random(2)
    words = ["New", "york", "city", "é", "日本", "the", "of", "a", "x y", "#"]
    made = [("en" if i % 3 else None, "".join(r.choice(words) + r.choice([" ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.randrange(60)))) for i in range(120)]
    return made + [("en", None), (None, ""), ("de", "a a a a a a a a a a a a a"), ("de", "ein Wort. " * 30), ("und", "new York " * 12), ("fr", " .,;\n"), ("en", "z" * 5000)]


@pytest.mark.parametrize(("least", "top"), [(10, 2000), (2, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top):
    docs = phrase_docs()
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 400)
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, block long, phrase string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top).collect())
    assert got == brute_collocations(docs, least, top)


def test_collocations_survive_colliding_fingerprints(spark, monkeypatch):
    """With fingerprints of one bit nearly all n-grams collide; the words decide."""
    import numpy as np

    docs, whole = phrase_docs(), collocations.Grams.prints

    def few(self, k):
        prints, at = whole(self, k)
        return (prints >> np.uint64(63)) << np.uint64(63), at

    grams = collocations.Grams(*few_blocks(docs))
    prints, at = few(grams, 2)
    first, n = grams.spelled(at, prints, 2)
    exact_first, exact_n = grams.spelled(*whole(grams, 2)[::-1], 2)
    assert sorted(zip(grams.phrases(first, 2), grams.lang[first].tolist(), n.tolist(), strict=True)) == sorted(zip(grams.phrases(exact_first, 2), grams.lang[exact_first].tolist(), exact_n.tolist(), strict=True))


def few_blocks(docs):
    block = collocations.Block()
    for lang, t in docs:
        block.add(lang or "und", (t or "").encode())
    row = block.row().to_pylist()[0]
    return row["langs"], row["ends"], row["ids"], row["words"]


def test_collocations_of_an_empty_table_and_their_sql(spark, sf):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert_same(queries.op13_collocations(spark, sf), connect(sf), queries.ORACLE_SQL["op13_collocations"])
