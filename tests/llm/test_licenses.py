import functools
import itertools
import random

from orderkeep.llm import licenses as L


def brute(text):
    words = L.words_of(text)
    places = []
    for k, (p, _) in enumerate(L.PHRASES):
        q = p.split()
        places += [(k, i) for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
    return len(words), sorted(places)


@functools.cache
def scanner():
    return L.Scanner(L.known_templates())


def test_places():
    rng = random.Random(3)
    pool = "under the mit license apache version 2 cc by nc MIT, License. É2 of granted copy".split()
    items = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["", "CC BY NC BY NC cc-by-nc", "xunder the mit license", "under-the-MIT-LICENSEs under\x00the mit license é"]
    for text, (n, places, *_) in zip(items, scanner().scan(items), strict=True):
        assert (n, sorted(places)) == brute(text)


def test_statistics():
    rng = random.Random(4)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    a = L.Automaton()
    for k, s in enumerate(seqs):
        a.add(k, s)
    a.finish()
    for _ in range(100):
        text = [rng.randint(0, 4) for _ in range(40)]
        for i, (v, n) in enumerate(a.statistics(text)):
            holds = lambda m: [(k, j + m - 1) for k, s in enumerate(seqs) for j in range(len(s) - m + 1) if s[j : j + m] == text[i + 1 - m : i + 1]]  # noqa: E731, B023
            assert n == max([0, *(m for m in range(1, i + 2) if holds(m))])
            if n:
                assert sorted(a.ends_of(v)) == sorted(holds(n)) and a.places[v] == len(holds(n))


def test_labels():
    s = scanner()
    mit, gpl = dict(L.NOTICES)["mit"], [t for label, t in L.NOTICES if label == "gpl-3"][1]
    edited = mit.split()
    edited[40] = "zzz"
    del edited[80:83]
    (a, b, c, d) = s.scan([f"foo bar {' '.join(edited)} baz", f"x {gpl.upper()}. y", "the copyright of the software is free and the use of the rights", "This work is licensed under the GNU General Public License, version 3."])
    assert set(a[2]) == {"mit"} and a[2]["mit"] > 0.9 and a[3][0][1] == 2
    assert b[2] == {"gpl-3": 1.0} == d[2]
    assert not c[2]


def test_each_template_labels_itself_alone():
    for label, text in L.known_templates():
        (found,) = scanner().scan([f"Some words before. {text} Others follow it."])
        assert set(found[2]) == {label} and found[2][label] > 0.99, (label, found[2])


def test_variants_are_told_apart():
    gpl = dict(L.known_templates())["gpl-3"]
    notice = lambda x: f"This work is licensed under a Creative Commons {x} 4.0 International License."
    cases = [(notice("Attribution-NoDerivatives"), {"cc-by-nd"}), (notice("Attribution-NonCommercial-ShareAlike"), {"cc-by-nc-sa"}), (notice("Attribution"), {"cc-by"})]
    cases += [(" ".join(gpl.split()[:400]), {"gpl-3"}), (" ".join(gpl.split()[100:]), {"gpl-3"}), (notice("Attribution") + " x y z " * 30 + dict(L.NOTICES)["mit"], {"cc-by", "mit"})]
    for (text, want), got in zip(cases, scanner().scan([c[0] for c in cases]), strict=True):
        assert set(got[2]) == want, (text[:60], got[2])


def chains_by_force(found):
    """Of all chains of matches the greatest coverage, by trying each set of them."""
    best = 0
    for size in range(1, len(found) + 1):
        for some in itertools.combinations(sorted(found), size):
            total = some[0][2]
            for (tj, pj, _), (te, pe, n) in itertools.pairwise(some):
                if not (tj < te and pj < pe and te - n - tj <= L.MAX_GAP):
                    break
                total += min(n, te - tj, pe - pj)
            else:
                best = max(best, total)
    return best


def test_chains():
    rng = random.Random(7)
    for _ in range(300):
        found = {(rng.randint(3, 90), rng.randint(3, 60), rng.randint(3, 8)) for _ in range(rng.randint(1, 8))}
        assert max(c for _, _, c in L._chains(list(found))) == chains_by_force(found)


def test_resolution():
    spans = [(10, 0.9, "a", 0, 20), (10, 1.0, "b", 5, 22), (3, 1.0, "c", 19, 40), (9, 0.7, "d", 50, 60), (9, 0.7, "e", 50, 60)]
    assert L._resolved(spans) == [("b", 5, 22, 1.0), ("c", 19, 40, 1.0), ("d", 50, 60, 0.7)]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    for name, rows in (("none", []), ("some", [(1, "under the MIT license", 5, "z", None)])):
        spark.createDataFrame(rows, "doc_id long, text string, n_words int, id string, spans string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = L.op10_licenses(spark, f"{tmp_path}/{name}").collect()
        assert [(r.doc_id, r.n_words, r.labels) for r in got] == [(1, 4, "mit")] * len(rows)


def test_query(spark, tmp_path):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (None, "word " * 200_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op10_licenses(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels, got[1].score) == (5, 1, 1, "mit", "mit", 1.0)
    assert got[2].labels == "" and got[2].first_word is None and got[2].n_words == 0 == got[3].n_words
    assert got[4].labels == "cc-by-nc" and got[None].n_words == 200_000
