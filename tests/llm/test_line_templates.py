from __future__ import annotations

import random

from plazametrics.llm import line_templates as L

from .test_minhash import shingles


def corpus():
    draw = random.Random(6)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))
    docs = []
    for i in range(40):
        lines = [prose(draw.randint(5, 20)) for _ in range(4)]
        lines.insert(draw.randint(0, 4), f"Posted by user{draw.randint(1, 99)} on {draw.randint(1, 28)} May")
        if i % 2:
            lines.insert(draw.randint(0, 4), f"Filed under the topic {prose(1)} of our site")
        lines.insert(draw.randint(0, 4), "")
        docs.append("\n".join(lines))
    own = [prose(9) for _ in range(5)]
    for _ in range(25):
        near = list(own)
        near[draw.randrange(5)] += " " + prose(1)
        docs.append("\n".join(near))
    return docs + [docs[0]] * 15 + [None, "", "\n\n", "one line only"]


def by_force(texts, least=10, depth=3, constant=0.6):
    """Recurring lines with sketches taken as given: one for each text that is not a near copy of another."""
    import collections

    mask = lambda line: tuple("*" if any(c.isdigit() for c in t) else t for t in line.split())
    distinct = sorted({t for t in texts if t})
    paths = collections.defaultdict(set)
    for t in distinct:
        for line in t.split("\n"):
            if line.split():
                m = mask(line)
                paths[len(m), m[:depth]].add(t)
    hot = {p for p, ts in paths.items() if len(ts) >= least}
    columns, total = collections.Counter(), collections.Counter()
    for t in distinct:
        for line in t.split("\n"):
            m = mask(line)
            if (p := (len(m), m[:depth])) in hot:
                total[p] += 1
                columns.update((p, i, x) for i, x in enumerate(m))
    templates = collections.defaultdict(set)
    template = lambda m, p: tuple(x if i < depth or 2 * columns[p, i, x] > total[p] else None for i, x in enumerate(m))
    for t in distinct:
        for line in t.split("\n"):
            m = mask(line)
            if (p := (len(m), m[:depth])) in hot:
                templates[p, template(m, p)].add(t)
    drop = {k for k, ts in templates.items() if len(ts) >= least and sum(x is not None for x in k[1]) >= constant * k[0][0]}
    keep = lambda line: not line.split() or ((p := (len(mask(line)), mask(line)[:depth])), template(mask(line), p)) not in drop
    return [t if t is None else "\n".join(line for line in t.split("\n") if keep(line)) for t in texts]


def test_equals_brute_force_where_texts_differ(spark):
    texts = [t for i, t in enumerate(corpus()) if not 40 <= i < 65]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.without_recurring_lines(docs).collect()}
    assert [got[i].text for i in range(len(texts))] == by_force(texts)
    assert sum(r.n_dropped for r in got.values()) >= 60


def test_near_copies_keep_their_lines(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, lines array<int>, key string")
    got = L.without_recurring_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert all(r.n_dropped == 0 for r in got.where("doc_id between 40 and 64").collect())
    assert got.where("text is null").count() == 1
    assert L.without_recurring_lines(docs.limit(0)).count() == 0


def by_force_with_groups(texts, least=10, depth=3, constant=0.6, alike=0.5):
    """Every rule in plain loops: templates by path, then groups of near copies among their texts."""
    import collections

    mask = lambda line: tuple("*" if any(c.isdigit() for c in t) else t for t in line.split())
    distinct = sorted({t for t in texts if t})
    paths, columns, total = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for t in distinct:
        for line in t.split("\n"):
            m = mask(line)
            p = (len(m), m[:depth])
            paths[p].add(t)
            total[p] += 1
            columns.update((p, i, x) for i, x in enumerate(m))

    def template(line):
        m = mask(line)
        p = (len(m), m[:depth])
        made = tuple(x if i < depth or 2 * columns[p, i, x] > total[p] else None for i, x in enumerate(m))
        return (p, made) if m and len(paths[p]) >= least and sum(x is not None for x in made) >= constant * len(m) else None

    holders = collections.defaultdict(set)
    for t in distinct:
        for line in t.split("\n"):
            if template(line):
                holders[template(line)].add(t)
    holders = {k: v for k, v in holders.items() if len(v) >= least}

    def unit(t, k):
        rest = [line for line in t.split("\n") if template(line) != k]
        whole, other = len(t.split()), len(" ".join(rest).split())
        return "\n".join(rest) if 4 * (whole - other) >= whole and other else t

    units = sorted({unit(t, k) for k, ts in holders.items() for t in ts})
    sets, parent = [shingles(u) for u in units], list(range(len(units)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= alike * len(a | sets[j]):
                parent[find(i)] = find(j)
    group = {u: find(i) for i, u in enumerate(units)}
    drop = {k for k, ts in holders.items() if len({group[unit(t, k)] for t in ts}) >= least}
    return [t if t is None else "\n".join(line for line in t.split("\n") if template(line) not in drop) for t in texts]


def test_long_passages_go_and_hot_near_copies_keep_theirs(spark):
    draw = random.Random(12)
    prose = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))
    passages, texts = [prose(n) for n in (55, 200, 400)], corpus()
    for passage in passages:
        for _ in range(30):
            lines = [prose(draw.randint(5, 40)) for _ in range(3)]
            lines.insert(draw.randint(0, 3), passage)
            texts.append("\n".join(lines))
    own = [prose(300), prose(80)]
    for i in range(120):
        words = own[1].split()
        words[draw.randrange(4, 80)] = f"{prose(1)}x{'abcdefghij'[i % 10]}"
        texts.append("\n".join([own[0], " ".join(words)]))
    # Twelve groups of near copies that have one footer.
    footer = prose(60)
    for _ in range(12):
        base = prose(60)
        texts += ["\n".join([base, prose(4), footer]) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.without_recurring_lines(docs).collect()}
    assert [got[i] for i in range(len(texts))] == by_force_with_groups(texts)
    after = [t for t in got.values() if t]
    assert not any(p in t.split("\n") for p in [*passages, footer] for t in after)
    assert sum(own[0] in t.split("\n") for t in after) == 120
