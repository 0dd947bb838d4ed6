"""The classifiers against plain versions: features as strings, models by Newton steps on dense matrices."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidepool.llm import quality, toxicity
from tidepool.llm.linear import calibrate, dual_coordinate_descent, logistic, rows_of


def sig(x):
    return 1 / (1 + np.exp(-x))


def hinge_by_newton(x, labels, cost):
    """Squared hinge loss with weights that balance the classes; the last column is the bias, penalised like the others."""
    y = np.where(labels, 1.0, -1.0)
    share = np.where(labels, labels.mean(), 1 - labels.mean())
    c, w = cost * 0.5 / share, np.zeros(x.shape[1])

    def loss(w):
        return 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(200):
        gap = np.maximum(0, 1 - y * (x @ w))
        slope = w - 2 * x.T @ (c * y * gap)
        on = gap > 0
        bend = np.eye(len(w)) + 2 * x[on].T @ (c[on][:, None] * x[on])
        step, t = np.linalg.solve(bend, slope), 1.0
        while loss(w - t * step) > loss(w) and t > 1e-9:
            t /= 2
        w = w - t * step
        if np.abs(slope).max() < 1e-10:
            break
    return w


def logistic_by_newton(x, labels, ridge):
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(100):
        p = sig(x @ w)
        slope = x.T @ (p - labels) + penalty * w
        w = w - np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + np.diag(penalty + 1e-12), slope)
        if np.abs(slope).max() < 1e-10:
            break
    return w


def random_rows(rng, n, width):
    lists = [np.sort(rng.choice(width, rng.integers(1, width), replace=False)) for _ in range(n)]
    dense = np.zeros((n, width))
    for i, own in enumerate(lists):
        dense[i, own] = 1
    return rows_of(lists), dense


@pytest.mark.parametrize("seed", range(3))
def test_dual_coordinate_descent_equals_newton(seed):
    rng = np.random.default_rng(seed)
    rows, dense = random_rows(rng, 60, 9)
    labels = dense[:, 0] + rng.random(60) > 0.9
    scale = rng.normal(size=9)
    weights, bias = dual_coordinate_descent(rows, scale, labels, cost=0.7, epochs=5000, tolerance=1e-10)
    want = hinge_by_newton(np.column_stack([dense * scale, np.ones(60)]), labels, 0.7)
    assert np.append(weights, bias) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("seed", range(3))
def test_logistic_equals_newton(seed):
    rng = np.random.default_rng(seed)
    rows, dense = random_rows(rng, 80, 6)
    extra = rng.random((80, 2))
    labels = dense[:, 1] + extra[:, 0] + rng.random(80) > 1.4
    got = logistic(rows, extra, labels, 6, ridge=0.3, steps=20000)
    assert got == pytest.approx(logistic_by_newton(np.column_stack([dense, extra, np.ones(80)]), labels, 0.3), abs=1e-3)


def shape(word):
    kinds = ["0" if 48 <= b < 58 else "A" if 65 <= b < 91 else "a" if 97 <= b < 123 or b > 127 else chr(b) for b in word]
    return "".join(k for k, before in zip(kinds, [None, *kinds]) if k != before)


def slow_shapes(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    shapes = ["same" if before is not None and w.lower() == before.lower() else shape(w) for w, before in zip(words, [None, *words])]
    return {tuple(shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)} or {()}


def slow_quality(texts, labels, folds=3, cost=0.1):
    sets = [slow_shapes(t) for t in texts]

    def fitted(chosen):
        names = sorted(set().union(*(sets[i] for i in chosen)))
        number = {f: k for k, f in enumerate(names)}
        good = [sum(f in sets[i] for i in chosen if labels[i]) + 1.0 for f in names]
        bad = [sum(f in sets[i] for i in chosen if not labels[i]) + 1.0 for f in names]
        # the operator counts over all its hashed features, seen or not, each with 1
        rest = quality.WIDTH - len(names)
        ratio = np.array([math.log(a / (sum(good) + rest)) - math.log(b / (sum(bad) + rest)) for a, b in zip(good, bad)])
        ratio /= np.mean([len(sets[i]) ** 0.5 for i in chosen])
        x = np.array([[f in sets[i] for f in names] for i in chosen]) * ratio
        w = hinge_by_newton(np.column_stack([x, np.ones(len(chosen))]), labels[chosen], cost)
        return lambda own: sum(w[number[f]] * ratio[number[f]] for f in own if f in number) + w[-1]

    margins = np.zeros(len(texts))
    for k in range(folds):
        model = fitted([i for i in range(len(texts)) if i % folds != k])
        for i in range(k, len(texts), folds):
            margins[i] = model(sets[i])
    model, (a, b) = fitted(list(range(len(texts)))), calibrate(margins, labels)
    return lambda t: sig(a * model(slow_shapes(t)) + b)


def some_texts(rng, n):
    good = ["The", "word", "is", "here,", "and", "ends.", "In", "1999", "été"]
    bad = ["BUY", "now!!", "$$$", "click", "click", "00:11", "A1-B2", "here"]
    labels = np.array([rng.random() < 0.5 for _ in range(n)])
    return [" ".join(rng.choice(good if y or rng.random() < 0.3 else bad) for _ in range(rng.randrange(1, 25))) for y in labels], labels


def test_quality_equals_plain_version():
    rng = random.Random(1)
    texts, labels = some_texts(rng, 120)
    rows = rows_of([x for part in quality.features_of(pa.array([t.encode() for t in texts])) for x in part])
    model, plain = quality.fit_rows(rows, labels), slow_quality(texts, labels)
    others, truth = some_texts(rng, 60)
    others += ["", " ", "unseen §§ words"]
    got = model.probability(rows_of([x for part in quality.features_of(pa.array([t.encode() for t in others])) for x in part]))
    assert got == pytest.approx(np.array([plain(t) for t in others]), abs=0.02)


def slow_words(text):
    """(what, part, times reached) of words and their beginnings."""
    low = bytes(b + 32 if 65 <= b < 91 else b for b in text.encode())
    words, found = re.findall(rb"[a-z\x80-\xff]+", low), {}
    for w in words:
        for n in (*toxicity.BEGINNINGS, None):
            if n is None or len(w) > n:
                key = (n, w if n is None else w[:n])
                found[key] = found.get(key, 0) + 1
    return {(f, least) for f, times in found.items() for least in (1, 2, 4) if times >= least}


def slow_z(sets, labels, least=3):
    out, n, n1 = {}, len(sets), int(sum(labels))
    for f in set().union(*sets):
        a, b = sum(f in s for s, y in zip(sets, labels) if y), sum(f in s for s, y in zip(sets, labels) if not y)
        if a + b < least:
            continue
        cells = [(a, (a + b) * n1 / n), (b, (a + b) * (n - n1) / n), (n1 - a, (n - a - b) * n1 / n), (n - n1 - b, (n - a - b) * (n - n1) / n)]
        g = 2 * sum(o * math.log(o / e) for o, e in cells if o)
        out[f] = math.copysign(math.sqrt(max(g, 0)), 1 if a * (n - n1) >= b * n1 else -1)
    return out


def slow_link(sets, before, labels):
    if all(labels) or not any(labels):
        p = (sum(labels) + 1) / (len(labels) + 2)
        return lambda own, earlier: p
    names = sorted((f for f, z in slow_z(sets, labels).items() if abs(z) >= toxicity.TELLS), key=repr)
    x = np.column_stack([np.array([[f in s for f in names] for s in sets], float).reshape(len(sets), -1), before, np.ones(len(sets))])
    w = logistic_by_newton(x, np.array(labels, float), 0.3)
    return lambda own, earlier: sig(np.array([*(f in own for f in names), *earlier, 1.0], float) @ w)


def slow_chain(sets, toxic, folds=3):
    def derived(chosen):
        z = slow_z([sets[i] for i in chosen], [toxic[i] for i in chosen])
        marks = {f for f, v in z.items() if v >= toxicity.MARKS}
        hits = {i: len(marks & sets[i]) for i in chosen}
        return {"abusive": {i: toxic[i] and hits[i] >= 1 for i in chosen}, "severe": {i: toxic[i] and hits[i] >= 3 for i in chosen}, "toxic": {i: toxic[i] for i in chosen}}

    n = len(sets)
    parts = [([i for i in range(n) if i % folds != k], [i for i in range(n) if i % folds == k]) for k in range(folds)]
    own, inner = derived(range(n)), [derived(inside) for inside, _ in parts]
    before, links = [[] for _ in range(n)], []
    for name in toxicity.CHAIN:
        out = [None] * n
        for (inside, outside), labels in zip(parts, inner) if name != "toxic" else ():
            link = slow_link([sets[i] for i in inside], [before[i] for i in inside], [labels[name][i] for i in inside])
            for i in outside:
                out[i] = link(sets[i], before[i])
        links.append(slow_link(sets, before, [own[name][i] for i in range(n)]))
        before = [b + [o] for b, o in zip(before, out)]

    def score(text):
        mine, earlier = slow_words(text), []
        for link in links:
            earlier = earlier + [link(mine, earlier)]
        return earlier

    return score


def test_chain_equals_plain_version():
    rng = random.Random(7)
    plain, vile = [f"word{chr(97 + k)}" for k in range(15)], ["grumble", "grumbling", "scoundrel", "blockhead"]

    def text(toxic):
        return " ".join(rng.choice(vile) if toxic and rng.random() < 0.35 else rng.choice(plain) for _ in range(rng.randrange(3, 14)))

    toxic = [rng.random() < 0.4 for _ in range(150)]
    texts = [text(y) for y in toxic]
    features = lambda ts: rows_of([x for part in toxicity.features_of(pa.array([t.encode() for t in ts])) for x in part])
    chain, slow = toxicity.fit_rows(features(texts), np.array(toxic)), slow_chain([slow_words(t) for t in texts], toxic)
    others = [text(k % 2 == 0) for k in range(40)] + ["", "GRUMBLE grumble grumble grumble", "unseen"]
    assert chain.probabilities(features(others)) == pytest.approx(np.array([slow(t) for t in others]), abs=0.03)
