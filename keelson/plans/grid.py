"""L2: one pipeline fitted for many parameter sets, each distinct prefix of stages once.

The stages (nested pipelines flattened) and the parameters that touch each of them make a trie: two
parameter sets share a node as long as they agree on every stage so far. A node is fitted once per
training table; where the trie branches, its output is cached and counted, and let go when the last
set below it is done. The nodes of a depth run concurrently on one bounded pool. Forests that differ only
in depth are one fit where that gives the same models (:mod:`keelson.plans.forests`).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import RFormula, RFormulaModel, SQLTransformer
from pyspark.sql import DataFrame

from keelson.plans.forests import bin_bounds, cut_models, depth_key, levels_in_one_pass


def flat_stages(stage) -> list:
    """The stages of a pipeline in order, those of nested pipelines in their place."""
    return [x for s in stage.getStages() for x in flat_stages(s)] if isinstance(stage, Pipeline) else [stage]


def rebuilt(stage, models):
    """The fitted form of ``stage`` from its flat models, nested as it is."""
    if isinstance(stage, Pipeline):
        return PipelineModel([rebuilt(s, models) for s in stage.getStages()])
    return next(models)


def leading_transformers(estimator, param_maps: Sequence[dict]) -> list:
    """The stages of a pipeline before its first estimator or first stage that a parameter set may touch."""
    stages = flat_stages(estimator) if isinstance(estimator, Pipeline) else []
    owned = {s.uid for s in stages}
    touched = {p.parent for m in param_maps for p in m}
    out = []
    for stage in [] if touched - owned else stages[:-1]:
        if isinstance(stage, Estimator) or stage.uid in touched:
            break
        out.append(stage)
    return out


#: Stages and evaluators that read the columns their parameters name; those below name them inside an expression.
_BY_NAME = ("pyspark.ml.", "keelson.plans.stages", "keelson.operators.metrics")
_EXPRESSIONS = (SQLTransformer, RFormula, RFormulaModel)


def columns_used(stages: Sequence, param_maps: Sequence[dict]) -> set[str] | None:
    """Every text among the parameters, in lower case, so all names of columns that the stages may read;
    None if a stage may read columns in another way."""
    values = [v for m in param_maps for v in m.values()]
    for stage in stages:
        if not type(stage).__module__.startswith(_BY_NAME) or isinstance(stage, _EXPRESSIONS):
            return None
        values += stage.extractParamMap().values()
    used = {v.lower() for value in values for v in (value if isinstance(value, (list, tuple)) else [value]) if isinstance(v, str)}
    return None if any("." in v or "`" in v for v in used) else used


@dataclass
class Node:
    """A stage under the parameters of its sets, for one training table."""

    stage: object
    params: dict
    sets: list[int]
    children: list[Node] = field(default_factory=list)
    model: object = None
    frame: DataFrame | None = None
    cached: bool = False

    def fit(self, frame: DataFrame, more_to_fit: bool, model=None) -> None:
        if model is not None:
            self.model = model
        elif isinstance(self.stage, Estimator):
            self.model = self.stage.fit(frame, self.params) if self.params else self.stage.fit(frame)
        else:
            self.model = self.stage.copy(self.params)
        if more_to_fit:
            self.frame = self.model.transform(frame)
            if len(self.children) > 1:
                self.frame = self.frame.persist(StorageLevel.MEMORY_AND_DISK)
                self.cached = True

    def release(self) -> None:
        if self.cached:
            self.frame.unpersist()
        self.frame, self.cached = None, False


def grid_trie(estimator: Estimator, param_maps: Sequence[dict]) -> list[Node]:
    """The first nodes of the trie. A parameter of none of the stages may act in any of them (a stage
    that holds an estimator of its own), so it is part of all."""
    stages = flat_stages(estimator)
    owned = {s.uid for s in stages}
    values: list = []

    def number(value) -> int:
        for i, v in enumerate(values):
            if v is value or type(v) is type(value) and _same(v, value):
                return i
        values.append(value)
        return len(values) - 1

    def own(stage, params: dict) -> dict:
        return {p: v for p, v in params.items() if p.parent == stage.uid or p.parent not in owned}

    def grow(depth: int, sets: list[int]) -> list[Node]:
        if depth == len(stages):
            return []
        groups: dict[tuple, Node] = {}
        for i in sets:
            params = own(stages[depth], param_maps[i])
            key = tuple(sorted((p.parent, p.name, number(v)) for p, v in params.items()))
            groups.setdefault(key, Node(stages[depth], params, [])).sets.append(i)
        for node in groups.values():
            node.children = grow(depth + 1, node.sets)
        return list(groups.values())

    return grow(0, list(range(len(param_maps))))


def _same(a, b) -> bool:
    try:
        return bool(a == b)
    except Exception:  # values without a plain truth of equality are their own
        return False


def fit_tries(estimator: Estimator, frames: Sequence[DataFrame], param_maps: Sequence[Sequence[dict]], pool: ThreadPoolExecutor) -> list[list[Node]]:
    """A fitted trie per training table; ``param_maps[i]`` are the sets of table ``i``."""
    stages = flat_stages(estimator)
    last_fit = max((i for i, s in enumerate(stages) if isinstance(s, Estimator)), default=-1)
    tries = [grid_trie(estimator, maps) for maps in param_maps]
    level = [(node, frame, None) for trie, frame in zip(tries, frames) for node in trie]
    open_: list[Node] = []
    wrap = inheritable_thread_target(frames[0].sparkSession) if frames else None
    try:
        for depth in range(len(stages)):
            jobs = _one_fit_each(level, pool, wrap)
            list(pool.map(wrap(lambda job, d=depth: _fit_job(*job, d < last_fit)), jobs))
            open_ += [node for node, _, _ in level if node.cached]
            level = [(child, node.frame if node.frame is not None else frame, node) for node, frame, _ in level for child in node.children]
            for node in [n for n in open_ if depth >= last_fit or not _feeds(n, level)]:
                node.release()
                open_.remove(node)
    finally:
        for node in open_:
            node.release()
    return tries


def _depth(node: Node) -> int:
    return node.params.get(node.stage.maxDepth, node.stage.getMaxDepth())


def _one_fit_each(level: list, pool: ThreadPoolExecutor, wrap) -> list[tuple[list[Node], DataFrame]]:
    """The nodes of a level with their frame, those that one fit serves together, the deepest first."""
    groups: dict = {}
    for node, frame, _ in level:
        key = depth_key(node.stage, node.params)
        groups.setdefault((id(frame), key) if key else id(node), ([], frame))[0].append(node)
    shared = [(sorted(nodes, key=_depth, reverse=True), frame) for nodes, frame in groups.values() if len(nodes) > 1]
    looks = {(id(frame), s.getFeaturesCol(), s.getMaxBins()): (frame, s)
             for nodes, frame in shared for s in [nodes[0].stage.copy(nodes[0].params)]}
    bins = dict(zip(looks, pool.map(wrap(lambda look: bin_bounds(*look)), looks.values())))
    jobs = [(nodes, frame) for nodes, frame in groups.values() if len(nodes) == 1]
    for nodes, frame in shared:
        stage = nodes[0].stage.copy(nodes[0].params)
        if levels_in_one_pass(stage, _depth(nodes[1]), bins[id(frame), stage.getFeaturesCol(), stage.getMaxBins()]):
            jobs.append((nodes, frame))
        else:
            jobs += [([node], frame) for node in nodes]
    return jobs


def _fit_job(nodes: list[Node], frame: DataFrame, more_to_fit: bool) -> None:
    deepest, *others = nodes
    deepest.fit(frame, more_to_fit)
    if others:
        for node, model in zip(others, cut_models(deepest.model, frame, [_depth(n) for n in others])):
            node.fit(frame, more_to_fit, model)


def _feeds(node: Node, level: list) -> bool:
    """Whether a node that is fitted next lies below ``node``."""
    below = list(node.children)
    waiting = {id(n) for n, _, _ in level}
    while below:
        if any(id(n) in waiting for n in below):
            return True
        below = [c for n in below for c in n.children]
    return False


def models_of(estimator: Estimator, trie: Sequence[Node], sets: int) -> list:
    """The fitted estimator of every parameter set."""
    paths: list[list] = [[] for _ in range(sets)]
    level = list(trie)
    while level:
        for node in level:
            for i in node.sets:
                paths[i].append(node.model)
        level = [c for n in level for c in n.children]
    return [rebuilt(estimator, iter(path)) for path in paths]
