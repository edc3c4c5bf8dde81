import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslog.operators import evaluate, features as feat, iforest, ocsvm, ranking, scoring, templates as tpl, training
from opslog.operators import sequences as sq
from opslog.sources import models


@pytest.fixture(scope="module")
def terms(spark):
    rows = [("a", "E1", 3), ("a", "E2", 1), ("b", "E1", 1), ("c", "E3", 2), ("c", "E1", 5)]
    return spark.createDataFrame(rows, "block_id string, term string, tf long")


def test_tfidf(spark, terms):
    blocks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "block_id string")
    vocab = feat.tfidf_fit(terms, blocks)
    got = {r["term"]: (r["idx"], r["df"], r["idf"]) for r in vocab.collect()}
    idf = {t: math.log(5 / (1 + df)) + 1 for t, df in (("E1", 3), ("E2", 1), ("E3", 1))}
    assert {t: g[0] for t, g in got.items()} == {"E1": 0, "E2": 1, "E3": 2}
    assert all(abs(got[t][2] - idf[t]) < 1e-12 for t in idf)
    weights = {(r["block_id"], r["term"]): r["weight"] for r in feat.tfidf_transform(terms, vocab, 1).collect()}
    raw = [(1 + math.log(3)) * idf["E1"], idf["E2"]]
    assert abs(weights["a", "E1"] - raw[0] / math.hypot(*raw)) < 1e-12
    assert weights["b", "E1"] == 1.0
    unseen = spark.createDataFrame([("z", "E9", 1)], terms.schema)
    assert feat.tfidf_transform(unseen, vocab).count() == 0


def test_features_of_a_block_without_known_terms(spark, terms):
    stats = spark.createDataFrame([("a", 4, 2), ("z", 4, 1)], "block_id string, seq_len long, unique_templates long")
    scaler = feat.scaler_fit(stats)
    assert scaler.first()["seq_len_scale"] == 1.0  # no deviation
    scaled = feat.scaler_transform(stats, scaler)
    vocab = feat.tfidf_fit(terms, stats)
    got = {r["block_id"]: r for r in feat.assemble_features(feat.tfidf_transform(terms, vocab), scaled, 3).collect()}
    assert got["z"]["indices"] == [3, 4] and got["z"]["values"] == [0.0, -1.0]
    assert got["a"]["indices"] == [0, 1, 3, 4] and got["a"]["values"][2:] == [0.0, 1.0]


def test_path_norm():
    assert iforest.path_norm([0, 1, 2]).tolist() == [0, 0, 1]
    assert abs(float(iforest.path_norm(256)) - 10.244) < 1e-2


@pytest.fixture(scope="module")
def cloud(spark):
    """500 rows around the origin and 5 far away."""
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", [0, 1, 2], rng.normal(0, 1, 3).tolist()) for i in range(500)]
    rows += [(f"out{i}", [0, 1, 2], (rng.normal(0, 1, 3) + 12).tolist()) for i in range(5)]
    return spark.createDataFrame(rows, "block_id string, indices array<int>, values array<double>").repartition(3)


def test_forest_finds_planted_outliers(cloud):
    nodes = iforest.iforest_fit(cloud, 3, trees=60)
    per_tree = nodes.where("left < 0").groupBy("tree").agg(F.sum("size").alias("n")).collect()
    assert len(per_tree) == 60 and {r["n"] for r in per_tree} == {256}
    assert nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * 256 - 1
    scored = iforest.iforest_score(cloud, nodes)
    lowest = [r["block_id"] for r in scored.orderBy("score_sample").limit(5).collect()]
    assert sorted(lowest) == [f"out{i}" for i in range(5)]
    offset = iforest.iforest_offsets(scored, [0.02])[0]
    flagged = iforest.predict(scored, offset).where("is_anomaly").count()
    assert 0 < flagged <= 0.02 * 505 + 1
    again = iforest.iforest_score(cloud.repartition(5), iforest.iforest_fit(cloud.repartition(2), 3, trees=60))
    key = lambda df: {r["block_id"]: r["score_sample"] for r in df.collect()}
    assert key(scored) == key(again)
    other = iforest.iforest_fit(cloud, 3, trees=60, seed=7)
    assert key(scored) != key(iforest.iforest_score(cloud, other))


def test_scores_follow_the_nodes_one_by_one(cloud):
    nodes = iforest.iforest_fit(cloud, 3, trees=10, sample=32)
    tree = {(r["tree"], r["node"]): r for r in nodes.collect()}

    def path(t, values):
        node, depth = tree[t, 0], 0
        while node["left"] >= 0:
            node = tree[t, node["left"] if np.float32(values[node["feature"]]) <= node["threshold"] else node["right"]]
            depth += 1
        return depth + float(iforest.path_norm(node["size"]))

    for r in iforest.iforest_score(cloud, nodes).limit(20).collect():
        mean = sum(path(t, r["values"]) for t in range(10)) / 10
        assert abs(r["score_sample"] + 2 ** (-mean / float(iforest.path_norm(32)))) < 1e-12


def test_equal_rows_give_one_leaf(spark):
    same = spark.createDataFrame([(str(i), [0], [1.0]) for i in range(9)], "block_id string, indices array<int>, values array<double>")
    nodes = iforest.iforest_fit(same, 1, trees=4)
    assert nodes.count() == 4
    assert iforest.iforest_score(same, nodes).select("score_sample").distinct().count() == 1


def pairwise(kernel, nu, steps=200_000):
    """The dual by moving weight between the two rows that violate optimality most."""
    n = len(kernel)
    cap, a = 1 / (nu * n), np.full(n, 1 / n)
    grad = kernel @ a
    for _ in range(steps):
        up, down = np.flatnonzero(a < cap * (1 - 1e-12)), np.flatnonzero(a > 1e-15)
        i, j = up[np.argmin(grad[up])], down[np.argmax(grad[down])]
        if grad[j] - grad[i] < 1e-9:
            break
        move = min((grad[j] - grad[i]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12), cap - a[i], a[j])
        a[i] += move
        a[j] -= move
        grad += move * (kernel[i] - kernel[j])
    free = (a > cap * 1e-6) & (a < cap * (1 - 1e-6))
    return grad, (grad[free].mean() if free.any() else (grad[a > 0].max() + grad[a < cap * 0.5].min()) / 2)


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_one_class_svm_equals_another_solver(spark, shift):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(shift, 1, (190, 4)), rng.normal(shift + 5, 1, (10, 4))])
    x[rng.random(x.shape) < 0.2] = 0.0
    x[:20] = x[20:40]  # repeated rows
    rows = [(f"b{i:03}", np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    features = spark.createDataFrame(rows, "block_id string, indices array<int>, values array<double>").repartition(3)
    nus = (0.03, 0.1, 0.5)
    fitted = ocsvm.ocsvm_fit(features, 4, nus)
    found = {(r["kernel"], r["nu"], r["block_id"]): (r["margin"], r["pred"]) for r in ocsvm.ocsvm_predict(features, fitted).collect()}
    gamma = 1 / (4 * x.var())
    kernels = {"linear": x @ x.T, "rbf": np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))}
    for (name, nu), machine in fitted.items():
        mean = np.diag(kernels[name]).mean()
        square = 2 * abs(machine.rho) + 1e-4 * mean
        assert machine.gap <= ocsvm.GAP * square * 10
        margin, rho = pairwise(kernels[name], nu)
        own = np.array([found[name, nu, f"b{i:03}"][0] for i in range(200)])
        assert np.abs(own - margin).max() < 0.02 * max(np.abs(margin).max(), 0.05 * mean)
        clear = np.abs(margin - rho) > 3 * machine.slack + 1e-6
        pred = np.array([found[name, nu, f"b{i:03}"][1] for i in range(200)])
        assert (pred[clear] == (margin < rho)[clear]).all() and pred.sum() <= nu * 200
        if machine.rho > 1e-3 * mean:
            assert abs(machine.rho - rho) < 0.01 * rho and (clear | (pred == 0)).all()


def test_rbf_svm_finds_planted_outliers(cloud):
    """At nu = 0.02 the optimum, by either solver, has some of the five on the margin, which is not below it."""
    model = ocsvm.ocsvm_fit(cloud, 3, nus=(0.05,), kernels=("rbf",))
    flagged = {r["block_id"] for r in ocsvm.ocsvm_predict(cloud, model).where("pred = 1").collect()}
    assert {f"out{i}" for i in range(5)} <= flagged


def test_mixture_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        points, share = rng.normal(1, 1, (8, 3)), np.append(rng.uniform(0, 2, 6), [0.0, 3.0])
        b, rho = ocsvm.best_mixture(points @ points.T, share)
        assert b.min() > -1e-9 and abs(b.sum() - 1) < 1e-8 and abs(share @ b - 1) < 1e-8
        slope = points @ points.T @ b - rho * share  # least and equal wherever b is used
        assert (slope[b > 1e-6] <= slope.min() + 1e-5).all()


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_a_machine_is_stored(spark, cloud, kernel):
    machine = ocsvm.ocsvm_fit(cloud, 3, nus=(0.1,), kernels=(kernel,))[kernel, 0.1]
    again = ocsvm.Machine.load(ocsvm.machine_table(spark, machine))
    pdf = cloud.toPandas()
    margins = machine.margins(pdf["indices"], pdf["values"])
    assert np.abs(again.margins(pdf["indices"], pdf["values"]) - margins).max() < 1e-12
    assert again.offset == machine.offset and (margins < machine.offset).sum() <= 0.1 * 505


def test_metrics(spark):
    rows = [(0, 1, 1), (0, 0, 1), (0, 1, 0), (0, 0, 0), (1, 1, 0), (1, 0, 0)]
    got = {r["config"]: r for r in evaluate.classification_metrics(
        spark.createDataFrame(rows, "config int, true_label int, pred int"), ["config"]).collect()}
    assert tuple(got[0])[1:] == (0.5, 0.5, 0.5, 0.5)
    assert tuple(got[1])[1:] == (0.0, 0.0, 0.0, 0.5)


def test_leaderboard_ranks_unrounded(spark):
    rows = [(0, 0.5, 0.1, 0.62141, 0.9), (1, 0.4, 0.1, 0.62142, 0.9), (2, 0.6, 0.1, 0.62141, 0.9)]
    df = spark.createDataFrame(rows, "config int, precision double, recall double, f1 double, accuracy double")
    got = evaluate.leaderboard(df, 3).collect()
    assert [r["config"] for r in got] == [1, 2, 0] and got[0]["f1"] == 0.6214


def sequential(messages, threshold):
    """The leader rule, one message after another."""
    leaders, out = [], []
    for tokens in messages:
        for k, head in enumerate(leaders):
            same = sum(a == b != "<*>" for a, b in zip(head, tokens))
            if len(head) == len(tokens) and same >= threshold * len(tokens):
                out.append(k)
                break
        else:
            out.append(len(leaders))
            leaders.append(tokens)
    return out


def test_leader_rule():
    rng = random.Random(3)
    for _ in range(30):
        messages = [[rng.choice(["a", "b", "c", "<*>"]) for _ in range(5)] for _ in range(40)]
        for threshold in (0.4, 0.6, 0.9):
            led = tpl.lead(messages, threshold)
            names = {x: k for k, x in enumerate(dict.fromkeys(led.tolist()))}
            assert [names[x] for x in led.tolist()] == sequential(messages, threshold)


def texts(spark, make_logs, messages):
    return make_logs([(m, None) for m in messages])


def test_mining(spark, make_logs):
    rng = random.Random(5)
    messages = []
    for i in range(300):
        messages.append(rng.choice([
            f"Receiving block blk_{i} from 10.0.0.{i % 9}:50010 for user{rng.choice('abc')} done",
            f"Heartbeat from host {rng.choice(['alpha', 'beta', 'gamma'])} ok", f"single{i}",
        ]))
    logs = texts(spark, make_logs, messages)
    got = {r["masked"]: r for r in tpl.mine_templates(logs).collect()}
    found = {r["template"] for r in got.values()}
    assert found == {"Receiving block <*> from <*> for <*> done", "Heartbeat from host <*> ok", "<*>"} or found == {
        "Receiving block <*> from <*> for <*> done", "Heartbeat from host <*> ok", "single<*>"}
    assert {r["template_id"] for r in got.values()} == set(range(1, 4))
    first = tpl.assign_templates(logs, tpl.mine_templates(logs)).orderBy("timestamp").first()
    assert first["template_id"] == 1


@pytest.mark.parametrize("n", [49, 51])
def test_size_does_not_change_the_answer(spark, make_logs, monkeypatch, n):
    monkeypatch.setattr(tpl, "LEAF_ROWS", 7)
    logs = texts(spark, make_logs, [f"start here user {chr(97 + i // 26)}{chr(97 + i % 26)} end" for i in range(n)])
    for rows in (1, 7, 50, 1000):
        assert {r["template"] for r in tpl.mine_templates(logs, round_rows=rows).collect()} == {"start here user <*> end"}


def test_rounds_equal_the_sequential_rule(spark, make_logs, monkeypatch):
    monkeypatch.setattr(tpl, "LEAF_ROWS", 5)
    rng = random.Random(9)
    messages = list(dict.fromkeys(" ".join(["go", "on"] + [rng.choice("abcd") for _ in range(4)]) for _ in range(70)))
    led = sequential([m.split(" ") for m in messages], 0.7)
    logs = texts(spark, make_logs, messages)
    for rows in (1, 7, 1000):
        got = {r["masked"]: r for r in tpl.mine_templates(logs, sim_threshold=0.7, round_rows=rows).collect()}
        assert [got[m]["template_id"] - 1 for m in messages] == led
        assert all(got[m]["leader"] == messages[led.index(led[i])] for i, m in enumerate(messages))


def test_new_messages_take_mined_templates(spark, make_logs):
    seen = [f"Heartbeat from host {h} ok blk_{i}" for i, h in enumerate(["alpha", "beta", "gamma"])]
    catalog = tpl.mine_templates(texts(spark, make_logs, seen))
    new = texts(spark, make_logs, ["Heartbeat from host delta ok blk_9", "Heartbeat from host", "else"])
    got = {r["id"]: r for r in tpl.assign_templates(new, catalog).collect()}
    assert (got[0]["template_id"], got[0]["parsed_template"]) == (1, "Heartbeat from host <*> ok <*>")
    assert got[1]["template_id"] is None and got[2]["parsed_template"] == "else"


def test_unseen_messages_keep_their_text(spark, make_logs):
    logs = texts(spark, make_logs, ["known 1", "other"])
    catalog = tpl.template_catalog(logs.where("id = 0"))
    got = {r["id"]: r for r in tpl.assign_templates(logs, catalog, split_rows=1).collect()}
    assert (got[0]["template_id"], got[0]["parsed_template"]) == (1, "known <*>")
    assert (got[1]["template_id"], got[1]["parsed_template"]) == (None, "other")


@pytest.fixture(scope="module")
def corpus(spark, make_logs):
    rng = random.Random(11)
    rows = []
    for block in range(120):
        kinds = ["open", "write", "close"] if block % 40 else ["panic", "reset", "panic", "drop"] * 3
        rows += [(f"{k} blk_{block} done", None) for k in kinds for _ in range(rng.choice([1, 2]))]
    rows += [("no block here", None)] * 5
    return make_logs(rows)


def term_loop_scores(df, model):
    """Features of each history term by term, with a plain dictionary as the vocabulary."""
    known = {r["term"]: (r["idx"], r["idf"]) for r in model.vocabulary.collect()}
    n_max = max(len(t.split(" ")) for t in known)
    scaler, out = model.scaler.first(), []
    for r in df.select("id", "tokens").collect():
        tokens = r["tokens"] or ["E0"]
        grams = Counter(" ".join(tokens[i:i + n]) for n in range(1, n_max + 1) for i in range(len(tokens) - n + 1))
        raw = {known[t][0]: (1 + math.log(tf)) * known[t][1] for t, tf in grams.items() if t in known}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        cells = [(i, v / norm) for i, v in sorted(raw.items())]
        for k, n in enumerate((len(tokens), len(set(tokens)))):
            c = feat.META[k]
            cells.append((len(known) + k, (n - scaler[f"{c}_mean"]) / scaler[f"{c}_scale"]))
        out.append((r["id"], [i for i, _ in cells], [v for _, v in cells]))
    indices, values = [x[1] for x in out], [x[2] for x in out]
    if model.machine is not None:
        machine = ocsvm.Machine.load(model.machine)
        scores, offset = machine.margins(indices, values), machine.offset
    else:
        scores, offset = iforest.Forest.load(model.forest).score(indices, values), model.forest.agg(F.max("offset")).first()[0]
    return {x[0]: float(s) - offset for x, s in zip(out, scores)}


@pytest.mark.parametrize("ngram_max,shift", [(1, 0), (3, 0), (3, 2_000_000)])
def test_scores_equal_those_of_a_loop(spark, corpus, ngram_max, shift):
    catalog = tpl.template_catalog(corpus).withColumn("template_id", F.col("template_id") + shift)
    model = training.train_model(corpus, ngram_max=ngram_max, catalog=catalog)
    shared = {r["id"]: r for r in scoring.score_logs(corpus, model).collect()}
    joined = {r["id"]: r for r in scoring.score_logs(corpus, model, shared_terms=0).collect()}
    looped = term_loop_scores(sq.block_history(tpl.enrich_logs(corpus, catalog)), model)
    assert shared.keys() == joined.keys() == looped.keys() and len(shared) == corpus.count()
    for i, row in shared.items():
        assert abs(row["score"] - looped[i]) < 1e-9 and abs(joined[i]["score"] - looped[i]) < 1e-9
        assert row["seq_len"] == len(row["sequence"].split(" "))
        assert row["unique_templates"] == len(set(row["sequence"].split(" ")))
    flagged = {i for i, r in shared.items() if r["is_anomaly"]}
    for gated in (scoring.incident_gate(scoring.score_logs(corpus, model)), scoring.incident_gate(corpus, model)):
        rows = gated.select("id", "raw_message", "sequence").collect()
        assert {r["id"] for r in rows} == flagged and len(rows) == len(flagged)
    with pytest.raises(ValueError):
        scoring.incident_gate(corpus)


@pytest.fixture(scope="module")
def machine_grid(spark, corpus):
    """A grid of machines only, over logs with labels."""
    labels = spark.createDataFrame([(f"blk_{b}", int(b % 40 == 0)) for b in range(120)], "block_id string, true_label int")
    catalog = tpl.template_catalog(corpus)
    tokens = sq.block_tokens(tpl.enrich_logs(corpus, catalog))
    return training.grid_search(tokens, labels, catalog, vectorizers=training.VECTORIZERS[1:2], contaminations=(), nus=(0.05,))


@pytest.mark.parametrize("config", [0, 1])
def test_a_machine_scores_saved_and_loaded(spark, corpus, machine_grid, tmp_path, config):
    model = machine_grid.models[config]
    kernel = model.machine.first()["kernel"]
    assert kernel == ocsvm.KERNELS[config]
    models.save_model(model, str(tmp_path))
    loaded = models.load_model(spark, str(tmp_path))
    assert loaded.forest is None
    shared = {r["id"]: r for r in scoring.score_logs(corpus, loaded).collect()}
    joined = {r["id"]: r for r in scoring.score_logs(corpus, loaded, shared_terms=0).collect()}
    looped = term_loop_scores(sq.block_history(tpl.enrich_logs(corpus, model.templates)), model)
    assert shared.keys() == joined.keys() == looped.keys()
    for i in shared:
        assert abs(shared[i]["score"] - looped[i]) < 1e-9 and abs(joined[i]["score"] - looped[i]) < 1e-9


def test_the_best_of_a_grid_is_saved_from_logs(spark, corpus, tmp_path):
    labels = spark.createDataFrame([(f"blk_{b}", int(b % 40 == 0)) for b in range(120)], "block_id string, true_label int")
    row, model = training.train_best(corpus, labels, vectorizers=training.VECTORIZERS[:1], contaminations=(0.025,), nus=(0.03,),
                                     kernels=("rbf",))
    models.save_model(model, str(tmp_path))
    loaded = models.load_model(spark, str(tmp_path))
    assert loaded.parts[-1] == ("forest" if row["model"] == training.FOREST else "machine")
    raised = scoring.incident_gate(corpus, loaded).select("block_id").distinct().collect()
    assert {r["block_id"] for r in raised} & {"blk_0", "blk_40", "blk_80"}


def test_a_model_is_published_at_once(spark, corpus, tmp_path):
    def model(n):
        return models.Model(**{name: spark.range(n) for name in models.PARTS})

    path = str(tmp_path)
    models.save_model(model(1), path)
    broken = models.Model(spark.range(9), spark.range(9), spark.range(9), spark.range(9).select(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        models.save_model(broken, path)
    assert models.load_model(spark, path).templates.count() == 1
    models.save_model(model(2), path)
    assert models.load_model(spark, path).forest.count() == 2
    with pytest.raises(ValueError, match="forest"):
        models.save_model(models.Model(*[spark.range(1)] * 3), path)


def test_training_finds_odd_blocks(spark, corpus):
    catalog = tpl.template_catalog(corpus)
    tokens = sq.block_tokens(tpl.assign_templates(corpus, catalog))
    fitted = training.fit_features(*training.count_terms(tokens))
    _, scores = training.fit_forest(fitted)
    lowest = {r["block_id"] for r in scores.orderBy("score_sample").limit(3).collect()}
    assert lowest == {"blk_0", "blk_40", "blk_80"}


def test_grid(spark, corpus):
    tokens = sq.block_tokens(tpl.assign_templates(corpus, tpl.template_catalog(corpus)))
    labels = spark.createDataFrame(
        [(f"blk_{b}", int(b % 40 == 0)) for b in range(119)] + [("blk_999", 1)], "block_id string, true_label int"
    )
    result = training.grid_search(
        tokens, labels, vectorizers=training.VECTORIZERS[:1], contaminations=(0.025, 0.03), nus=(0.03,)
    )
    rows = result.leaderboard().collect()
    assert len(rows) == 4 and rows[0]["f1"] == max(r["f1"] for r in rows)
    assert {r["param"] for r in rows} == {"cont=0.025", "cont=0.03", "nu=0.03"}
    best, model = result.best()
    assert best["config"] == rows[0]["config"] and model is result.models[best["config"]]


def test_unlike_messages_of_one_leaf_take_one_round(spark, make_logs, monkeypatch):
    words = [f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(2500)]
    logs = texts(spark, make_logs, [f"go on {w} {w}{w} x{w} y{w} end{w}" for w in words])
    staged = []
    true = tpl.stage
    monkeypatch.setattr(tpl, "stage", lambda df, name: staged.append(name) or true(df, name))
    assert tpl.mine_templates(logs).agg(F.countDistinct("template_id")).first()[0] == 2500
    assert staged.count("head") == 1


def test_sequences_are_scored_in_parts_and_equal_features_once(monkeypatch):
    class Sums:
        columns, seen = np.arange(3), []

        def score_matrix(self, matrix, squares):
            self.seen.append(len(matrix))
            return matrix.sum(axis=1) + squares

    codes = np.array([scoring._code([i]) for i in range(3)])
    order = np.argsort(codes)
    scorer = scoring.SequenceScorer(codes[order], np.arange(3)[order], np.ones(3)[order], 1,
                                    np.array([[0.0, 1.0], [0.0, 1.0]]), scoring.Detector(Sums(), 0.0))
    rng = np.random.default_rng(4)
    sequences = [rng.integers(0, 3, size=n) for n in rng.integers(1, 6, size=200)]
    whole = Sums().score_matrix(*scorer.matrix(sequences))
    Sums.seen.clear()
    monkeypatch.setattr(scoring, "PART_CELLS", 100)
    assert np.allclose(scorer.score(sequences), whole, atol=1e-12)
    assert max(Sums.seen) <= 34 and sum(Sums.seen) < 200


def test_mining_stores_messages_without_their_tokens(spark, make_logs, monkeypatch):
    stored, stage = [], tpl.stage
    monkeypatch.setattr(tpl, "stage", lambda df, name: (stored.append((name, df.columns)), stage(df, name))[1])
    logs = texts(spark, make_logs, [f"start here user {chr(97 + i)} end" for i in range(9)])
    assert tpl.mine_templates(logs, round_rows=2).select("template").distinct().count() == 1
    assert {name for name, _ in stored} >= {"masks", "head", "found", "members"}
    assert not any({"tokens", "head"} & set(columns) for _, columns in stored)


def test_mining_stores_no_text_of_a_leafs_only_message(spark, make_logs, monkeypatch):
    stored, true = [], tpl.stage

    def stage(df, name):
        out = true(df, name)
        stored.append((name, out.where(F.col("masked").isNotNull()).count() if "masked" in df.columns else 0))
        return out

    monkeypatch.setattr(tpl, "stage", stage)
    monkeypatch.setattr(ranking, "stage", stage)
    lone = [f"{chr(97 + i // 26)}{chr(97 + i % 26)} is alone" for i in range(300)]
    logs = texts(spark, make_logs, [*lone, *lone, "start here user a end", "start here user b end"])
    got = {r["masked"]: r for r in tpl.mine_templates(logs).collect()}
    assert len(got) == 302 and all(got[m]["leader"] == got[m]["template"] == m and got[m]["n"] == 2 for m in lone)
    assert [got[m]["template_id"] for m in lone] == list(range(1, 301))
    assert {got[f"start here user {c} end"]["template"] for c in "ab"} == {"start here user <*> end"}
    assert max(n for _, n in stored) < 30  # a message in a thousand passes the bitmap by chance


def test_messages_first_seen_in_the_same_place_go_by_text(spark, make_logs):
    messages = ["go on z a", "alone", "go on c b", "go on b b", "other here", "only"]
    logs = texts(spark, make_logs, messages).withColumn("timestamp", F.lit(None).cast("timestamp")).withColumn(
        "id", F.when(F.col("id") < 5, 7).cast("long"))
    got = [(r["template_id"], r["masked"], r["template"], r["leader"]) for r in tpl.mine_templates(logs).collect()]
    assert sorted(got) == [
        (1, "only", "only", "only"), (2, "alone", "alone", "alone"), (3, "go on b b", "go on <*> <*>", "go on b b"),
        (3, "go on c b", "go on <*> <*>", "go on b b"), (3, "go on z a", "go on <*> <*>", "go on b b"),
        (4, "other here", "other here", "other here")]


def test_bitmap_lets_all_members_pass(spark, monkeypatch):
    rows = spark.range(20_000).withColumn("hash", F.xxhash64("id"))
    some = rows.where("id % 9 = 0").select("hash")
    for bits in (1 << 27, 1 << 15):
        monkeypatch.setattr(tpl, "MAX_BITS", bits)
        passed = tpl._among(rows, some)
        assert passed.join(some, "hash").count() == some.count() and passed.columns == ["id", "hash"]
    monkeypatch.setattr(tpl, "MAX_BITS", 1 << 27)
    assert tpl._among(rows, some).count() < 1.5 * some.count() and tpl._among(rows, some.limit(0)).count() == 0
