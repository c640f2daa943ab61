import random
import re
import time
from collections import Counter

from mensura.llm.license_scan import TEMPLATES, bank, license_scan, op10_license_scan, words_of

BANK = bank(TEMPLATES)


def plain_words(text):
    """Lower-cased runs without ASCII punctuation, as text; only A-Z and ASCII white space count."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x20!-/:-@\[-`{-~\x7f]+", lower)


def plain_shingles(text):
    words = plain_words(text)
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_versions(name, shingles):
    found = re.search(r"-(\d+)\.(\d+)", name)
    for said in ((found[1], found[2]), (f"v{found[1]}", found[2]), ("version", found[1]), (f"v{found[1]}",)) if found else ():
        held = {s for s in shingles if any(s[i : i + len(said)] == said for i in range(5))}
        if held:
            return held
    return set()


PLAIN = [(name, own, set(own), 1 << max(0, len(own) - 1).bit_length(), plain_versions(name, set(own))) for name, own in ((n, plain_shingles(t)) for n, t in TEMPLATES)]


def plain_runs(places, least, most, version):
    """The fullest run of all, then of what is left of it and right of it; by trying every end."""
    best, left, seen = None, 0, Counter()
    for right, (at, shingle) in enumerate(places):
        seen[shingle] += 1
        while at - places[left][0] > most or seen[places[left][1]] > 1:
            seen[places[left][1]] -= 1
            if not seen[places[left][1]]:
                del seen[places[left][1]]
            left += 1
        rank = (len(seen), places[left][0] - at)
        if len(seen) >= least and (not version or version & seen.keys()) and (best is None or rank > best[0]):
            best = rank, left, right
    if best is None:
        return []
    (k, _), left, right = best
    return [*plain_runs(places[:left], least, most, version), (places[left][0], places[right][0] + 5, k), *plain_runs(places[right + 1 :], least, most, version)]


def brute(text):
    """Every template against all places of the text, without hashes, windows or anything of the operator's; of overlapping matches of
    two licenses each is compared with all kept."""
    here, found = plain_shingles(text), []
    held = set(here)
    for name, own, wanted, step, version in PLAIN:
        if len(wanted & held) >= 0.8 * len(wanted):
            places = [(i, s) for i, s in enumerate(here) if s in wanted]
            found += [(k / len(wanted), k, a, b, name, PLAIN.index((name, own, wanted, step, version))) for a, b, k in plain_runs(places, 0.8 * len(wanted), 2 * step, version)]
    kept = []
    for m in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[5])):
        rivals = [k for k in kept if m[2] < k[3] and k[2] < m[3] and k[4] != m[4]]
        if all(m[4].startswith(f"{k[4]}-") or 2 * k[1] <= m[1] and not k[4].startswith(f"{m[4]}-") for k in rivals):
            kept = [k for k in kept if k not in rivals] + [m]
    out = []
    for name in {m[4] for m in kept}:
        spans = []
        for a, b, share in sorted((m[2], m[3], m[0]) for m in kept if m[4] == name):
            if spans and a < spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), max(share, spans[-1][2]))
            else:
                spans.append((a, b, share))
        out += [(name, *span) for span in spans]
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_many_notices_in_one_text():
    """Bundled licenses: the work grows with the text, not with its square; and each run is found."""
    notices = [t for n, t in TEMPLATES if len(t.split()) < 40]
    rng = random.Random(4)
    few = " and ".join(rng.choice(notices) for _ in range(60))
    assert BANK.scan(few) == brute(few)
    took = []
    for n in (5_000, 20_000):
        text = " and ".join(rng.choice(notices) for _ in range(n))
        began = time.process_time()
        assert len(BANK.scan(text)) > n / 4
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1 and took[1] < 60


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op10_license_scan(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        assert got[k]["spans"] == ",".join(f"{n}:{a}:{b}" for n, a, b, _ in brute(text)), k
    assert any(r["n_matches"] for r in got.values())


def test_planted():
    rng = random.Random(2)
    for name, text in TEMPLATES * 3:
        words = text.split()
        if len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        noise = [f"w{rng.randrange(999)}" for _ in range(rng.randrange(300))]
        at = rng.randrange(len(noise) + 1)
        found = BANK.scan(" ".join([*noise[:at], *words, *noise[at:]]))
        assert name in {n for n, *_ in found}
        assert found == brute(" ".join([*noise[:at], *words, *noise[at:]]))


def test_corners(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "released UNDER the MIT license", "c"), (4, "x " * 100000 + "Licensed under CC BY-NC 4.0.", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = sorted((r["doc_id"] or 0, [m["license"] for m in r["matches"]]) for r in license_scan(df).collect())
    assert got == [(0, ["MIT"]), (1, []), (2, []), (2, []), (4, ["CC-BY-NC-4.0"])]
    assert license_scan(df.limit(0)).count() == 0


GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


def test_neighbours_keep_their_names():
    """Notices that are no templates: with a word changed, with a program's name, short ones in other words."""
    notices = {
        "GPL-2.0": GNU.format(";", "", ";", 2).replace("This program", "Ouenha"),
        "GPL-3.0": GNU.format(":", "", ",", 3).replace("This program", "Ouenha"),
        "LGPL-3.0": GNU.format(":", "Lesser ", ",", 3).replace("This program", "Ouenha"),
        "AGPL-3.0": GNU.format(":", "Affero ", ",", 3).replace("This program", "Ouenha"),
        "LGPL-2.1": GNU.format(";", "Lesser ", ";", 2.1).replace("This program", "This library"),
        "MIT": "The code is distributed under the MIT License, see the file.",
        "Apache-2.0": "Made available to all under the Apache License, Version 2.0, as is.",
        "CC-BY-3.0": "The figures are under a Creative Commons Attribution 3.0 Unported License.",
        "EPL-2.0": "Offered under the Eclipse Public License, Version 2.0, to all.",
    }
    for name, text in notices.items():
        assert {n for n, *_ in BANK.scan(f"One two three. {text} Four five six.")} == {name}
    both = BANK.scan(f"{notices['GPL-2.0']} {notices['AGPL-3.0']}")
    assert [n for n, *_ in both] == ["GPL-2.0", "AGPL-3.0"] and both[0][2] <= both[1][1]
    assert BANK.scan(GNU.format(";", "", ";", 9)) == []  # no such version


def test_whole_texts():
    whole = {name: text for name, text in TEMPLATES if len(text.split()) > 900}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "CC0-1.0"} <= whole.keys()
    for name, text in whole.items():
        words = text.split()
        words[::150] = ["changed"] * len(words[::150])
        assert [n for n, *_ in BANK.scan(" ".join(words))] == [name]


def test_inserted_words_at_every_offset():
    """A notice made longer by a line of its own is found wherever it starts."""
    notice = next(text for name, text in TEMPLATES if name == "BSD" and "Redistribution and use" in text).split()
    longer = [*notice[:16], *(f"c{i}" for i in range(22)), *notice[16:]]
    for offset in range(64):
        [(name, start, stop, share)] = BANK.scan(" ".join([*(f"w{i}" for i in range(offset)), *longer, "x " * 200]))
        assert (name, start, stop) == ("BSD", offset, offset + len(words_of(" ".join(longer)))) and 0.9 < share < 1, offset


def tuples(text):
    words = re.findall(r"[^\s!-/:-@\[-`{-~]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_on_edited_copies():
    """Copies with words changed, dropped and put in, told by plain sets of 5-word shingles: those that hold 0.8 of a template are found."""
    rng, sets = random.Random(5), [(name, tuples(text)) for name, text in TEMPLATES]
    planted = found = wrong = 0
    for name, text in TEMPLATES:
        own = tuples(text)
        if len(own) < 20:
            continue
        for _ in range(3 if len(own) > 400 else 12):
            words = text.split()
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                at, how = rng.randrange(len(words)), rng.randrange(3)
                words[at : at + (how != 2)] = [] if how == 1 else [f"new{rng.randrange(99)}"]
            copy = " ".join(words)
            here, around = tuples(copy), lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(400)))
            names = {n for n, *_ in BANK.scan(f"{around()} {copy} {around()}")}
            share = len(own & here) / len(own)
            if share >= 0.8:
                planted += 1
                # another license may hold the place only with as high a share
                found += name in names or any(n in names and len(s & here) / max(1, len(s)) >= share for n, s in sets)
            wrong += any(max((len(s & here) / len(s) for n, s in sets if s and n == x), default=0) < 0.8 for x in names)
    # the few others have lost the version, which a name with one must have
    assert planted > 200 and found / planted >= 0.95 and wrong == 0
