"""The numeric kernels of the learnt operators against plain loops; scratch folders."""

import itertools
import math
import types

import numpy as np
import pytest
from gleaner.llm import common, html_main, nbsvm, toxicity


def test_log_count_ratios_and_margins():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 12)) for _ in range(60)]
    y = np.array([int(np.isin([1, 2, 3], r).any()) for r in rows])
    fresh = np.arange(60) % 5 == 0
    model = nbsvm.fit(rows, y, fresh)
    used = [i for i in range(60) if not fresh[i]]
    ratio = {}
    for b in range(30):
        p = 1 + sum(b in rows[i] for i in used if y[i] == 1)
        q = 1 + sum(b in rows[i] for i in used if y[i] == 0)
        n1, n0 = sum(y[i] == 1 for i in used), sum(y[i] == 0 for i in used)
        ratio[b] = 0.0 if p + q <= 3 else math.log(p / n1) - math.log(q / n0)
    # weights are ratio times a weight of the hinge-loss model on the scaled rows
    weights, bias = nbsvm.descend([rows[i] for i in used], np.where(y[used] == 1, 1.0, -1.0), np.array([ratio.get(b, 0.0) for b in range(nbsvm.BUCKETS)]))
    for i in range(60):
        margin = sum(ratio[int(b)] * weights[b] for b in rows[i]) / math.sqrt(len(rows[i])) + bias
        assert abs(model.score(rows[i]) - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-9


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 12, 6)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    scale = rng.normal(0, 1, 12)
    w, b = nbsvm.descend(rows, y, scale, rounds=3000)
    cost = np.where(y > 0, 0.5 * 40 / (y > 0).sum(), 0.5 * 40 / (y < 0).sum())
    dense = np.zeros((40, 13))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r] / math.sqrt(len(r))
    dense[:, 12] = 1

    def primal(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()

    best = np.append(w, b)
    assert all(primal(best) <= primal(best + step) + 1e-3 for step in rng.normal(0, 0.02, (400, 13)))


def test_convolution_and_pooling():
    rng = np.random.default_rng(8)
    net = toxicity.Net.fresh(1)
    for n in (0, 1, 2, 7):
        ids = rng.integers(1, 500, (n, 2))
        most, place = net.pooled(ids)
        word = [net.table[a] + net.table[b] for a, b in ids]
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best, at = 0.0, -1
                for i in range(n - w + 1):
                    r = float(np.concatenate(word[i : i + w]) @ net.filters[k][:, f] + net.filter_bias[k][f])
                    if r > best + 1e-7:
                        best, at = r, i
                assert abs(most[k * toxicity.FILTERS + f] - best) < 1e-4 and place[k * toxicity.FILTERS + f] == at


def test_long_texts_are_convolved_in_parts(monkeypatch):
    net, ids = toxicity.Net.fresh(2), np.random.default_rng(9).integers(1, 900, (300, 2))
    whole = net.pooled(ids)
    monkeypatch.setattr(toxicity, "PART", 16)
    parts = net.pooled(ids)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and (whole[1] == parts[1]).all()


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = np.random.default_rng(3)
    for _ in range(30):
        nodes = [html_main.Node("body", {}, None)]
        for _ in range(8):
            parent = nodes[rng.integers(0, len(nodes))]
            child = html_main.Node("div", {}, parent)
            parent.children.append(child)
            nodes.append(child)
        nodes = html_main.flat(nodes[0])
        logits = rng.normal(0, 2, len(nodes))
        best, want = -math.inf, None
        for labels in itertools.product((False, True), repeat=len(nodes)):
            if any(on and n.parent is not None and not labels[n.parent.number] for n, on in zip(nodes, labels, strict=True)):
                continue
            total = sum(-math.log1p(math.exp(-x if on else x)) for x, on in zip(logits, labels, strict=True))
            if total > best:
                best, want = total, labels
        assert html_main.decode(nodes, logits).tolist() == list(want)


def test_trees_are_walked_as_written():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (50, html_main.N_FEATURES)).astype(np.float32)
    trees = html_main.trained()
    got = trees.logits(x)
    for row, total in zip(x, got, strict=True):
        want = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            want += v[at - len(f)]
        assert abs(total - want) < 1e-9


def test_subtree_statistics():
    root = html_main.parse("<div class='menu box'><a href=x>one two</a><p>three, four.</p></div><p>five six seven eight nine</p>")
    nodes = html_main.flat(root)
    x = html_main.features(nodes)
    div, link = nodes[1], nodes[2]
    assert (div.tag, link.tag) == ("div", "a")
    own, inside = len("one two"), len("one two") + len("three, four.")
    assert math.isclose(x[1, 2], math.log1p(inside), rel_tol=1e-6) and math.isclose(x[1, 3], own / inside, rel_tol=1e-6)
    assert x[1, 1] == 1 and x[2, 1] == 2 and x[2, 3] == 1 and x[1, 10] == 0 and x[4, 10] == 0.5
    parts = list(html_main.PARTS)
    assert x[1, 22 + parts.index("menu")] == 1 and x[2, 22 + len(parts) + parts.index("menu")] == 1


@pytest.mark.parametrize("master,ok", [("local", True), ("local[4]", True), ("local-cluster[3,2,1000]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_machine_local_scratch_on_a_cluster(master, ok):
    unset = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: default), sparkContext=types.SimpleNamespace(master=master))
    named = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: "file:///shared/"), sparkContext=unset.sparkContext)
    assert common.shared_folder(named) == "file:///shared"
    if ok:
        assert common.shared_folder(unset).startswith("file:///tmp/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(unset)
