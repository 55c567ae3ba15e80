"""Plain Python versions of the operators, for small tables."""

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_components(rows, n, percent):
    """{id: (set size, component)} for rows (id, text) with distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    by_shingle, pairs = defaultdict(list), set()
    for i, s in sets.items():
        for x in s:
            for j in by_shingle[x]:
                pairs.add((j, i))
            by_shingle[x].append(i)
    links = []
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    named = components(sets, links)
    return {i: (len(s), named[i]) for i, s in sets.items()}


def dedup_lines(rows, min_docs):
    """[(kept text, lines, dropped)] for texts."""
    split = [(t or "").split("\n") for t in rows]
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    seen = defaultdict(set)
    for i, lines in enumerate(split):
        for line in lines:
            seen[key(line)].add(i)
    out = []
    for lines in split:
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text, items, size):
    """(words, words hit, found items) of a text; items are (id, text)."""
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, body in items:
        own = WORD.findall((body or "").translate(LOWER))
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


SECRETS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_secrets(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(s, SECRETS[k][0], e) for s, k, e in sorted(spans)]


def content_paths(found):
    """The content paths of blocks ``(path, text, inside an article, named apart)``: sums, smoothing and threshold one by one."""
    paths = []
    for p, *_ in found:
        if p not in paths:
            paths.append(p)
    of = lambda p: [b for b in found if b[0] == p]
    size = lambda bs: sum(len(t) for _, t, _, _ in bs)
    mean = [size(of(p)) / len(of(p)) for p in paths]
    marks = [(sum(c in ".,;:!?…。、，！？；：" for _, t, _, _ in of(p) for c in t) + 0.1) / len(of(p)) for p in paths]
    near = lambda x, k: 0.15 * x[max(k - 1, 0)] + 0.7 * x[k] + 0.15 * x[min(k + 1, len(x) - 1)]
    share = size([b for b in found if any(i for _, _, i, _ in of(b[0]))]) / size(found) if found else 0
    score = {}
    for k, p in enumerate(paths):
        score[p] = near(mean, k) * near(marks, k)
        if share and not any(i for _, _, i, _ in of(p)):
            score[p] *= min(1, (1 - share) / (3 * share)) ** 4
        if any(n for *_, n in of(p)):
            score[p] *= 0.02 if mean[k] >= 140 else 0
    limit = min(0.05 * max(score.values(), default=0), sum(score.values()) / max(1, len(score)))
    return {p for p in paths if score[p] >= limit and score[p] > 0}


def quality_score(model, text):
    """The score of one text, sum by sum, from a model's table and weights."""
    import math

    from millrace.llm import quality
    from millrace.llm.features import _REPEAT, words_and_marks

    tokens, rows = (text or "").split(), []
    for k, t in enumerate(tokens):
        rows += [model.table[quality.bucket(p)] for p in words_and_marks(t)]
        if k and t == tokens[k - 1]:
            rows += [model.table[quality.bucket(p)] for p in words_and_marks(_REPEAT)]
    width = model.table.shape[1]
    x = [sum(float(r[j]) for r in rows) / max(1, len(rows)) for j in range(width)]
    z = [(x[j] - model.mean[j]) / model.scale[j] for j in range(width)]
    hidden = [max(0.0, sum(z[j] * model.w1[j][h] for j in range(width)) + model.b1[h]) for h in range(len(model.b1))]
    logit = sum(h * w for h, w in zip(hidden, model.w2, strict=True)) + model.b2
    return 1 / (1 + math.exp(-min(40, max(-40, logit / model.temperature))))


def chain_scores(chain, text):
    """The probabilities of one text, link by link."""
    import math

    from millrace.llm.features import _REPEAT, with_beginnings

    tokens = (text or "").split()
    parts, shared = set(), {}
    for t in set(tokens):
        own = with_beginnings(t)
        parts.update(own)
        for b in {p for p in own if p[0] == "b"}:
            shared[b] = shared.get(b, 0) + 1
    parts |= {"t" + b[1:] for b, n in shared.items() if n > 1}
    if sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) * 5 >= len(tokens) > 1:
        parts.add(_REPEAT)
    out = []
    for link in chain.links:
        z = link.b + sum(link.w[chain.names[p]] for p in parts if p in chain.names) + sum(d * p for d, p in zip(link.d, out, strict=True))
        out.append(1 / (1 + math.exp(-min(40, max(-40, z)))))
    return out


def template_text(html):
    """The article of a page of the test tables, whose template is known: its heading and paragraphs."""
    from html import unescape

    inside = re.search(r"<article>(.*?)</article>", html or "", re.S)
    pieces = re.split(r"</?(?:h1|p)\b[^>]*>", inside[1]) if inside else []
    texts = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))).split()) for p in pieces)
    return "\n".join(t for t in texts if t)
