"""Operators by name, and a client that runs them as cancellable tasks."""

from __future__ import annotations

import functools
import importlib
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import InheritableThread  # noqa: F401  (tags follow threads that inherit)
from pyspark.sql import SparkSession

MODULES = ("graph", "functions.stats", "sources.formats", "operators.prep", "operators.local", "operators.paths", "operators.spectral", "operators.connectivity", "operators.compare", "operators.roles", "operators.random_graphs", "operators.nulls", "operators.regression", "operators.bayes", "operators.biased", "operators.layouts", "operators.summaries")

#: Names whose snake form is not the function's.
ALIASES = {
    "makeDenseGraph": "graph.Graph.from_matrix",
    "isDenseGraph": "graph.is_graph",
    "isEdgeListInput": "graph.is_edge_list_input",
    "denseGraphToMatrix": "graph.Graph.to_matrix",
    "neighbors": "graph.Graph.neighbors",
    "hasTie": "graph.Graph.has_tie",
    "tieWeight": "graph.Graph.tie_weight",
    "isMissingTie": "graph.Graph.is_missing_tie",
    "stackcount": "graph.Graph.stackcount",
    "setMaxGraphOrder": "graph.set_max_graph_order",
    "cugTest": "operators.nulls.cug_test",
    "cugtest": "operators.nulls.cugtest",
    "event2dichot": "operators.prep.event2dichot",
    "gclustCentralgraph": "operators.compare.gclust_centralgraph",
    "gclustBoxstats": "operators.compare.gclust_boxstats",
    "createSeededRng": "operators.random_graphs.create_seeded_rng",
    "coefLnam": "operators.regression.coef_lnam",
    "seLnam": "operators.regression.se_lnam",
    "potscaleredMcmc": "operators.bayes.potscalered_mcmc",
    "evalEdgeperturbation": "operators.regression.eval_edgeperturbation",
    "gplotLayout": "operators.layouts.layout",
    "layoutByMode": "operators.layouts.layout",
    "plotSociomatrix": "operators.layouts.plot_sociomatrix",
    "componentDist": "operators.connectivity.component_dist",
    **{f"{a}{b}": f"operators.summaries.{c}_null_test" for b in ("Qaptest", "Cugtest") for a, c in (("summary", "summary"), ("print", "print"), ("printSummary", "print_summary"), ("plot", "plot"))},
    "printCugTest": "operators.summaries.print_null_test",
    "plotCugTest": "operators.summaries.plot_null_test",
    **{f"{a}{b}": f"operators.summaries.{c}_fit" for b in ("Netlm", "Netlogit", "Pstar") for a, c in (("summary", "summary"), ("print", "print"), ("printSummary", "print_summary"))},
    **{f"{a}Bbnam{b}": f"operators.summaries.{c}_bbnam" for b in ("", "Pooled", "Actor") for a, c in (("summary", "summary"), ("print", "print"), ("printSummary", "print_summary"), ("plot", "plot"))},
    **{f"{a}BbnamFixed": f"operators.summaries.{c}_bbnam_fixed" for a, c in (("print", "print"), ("printSummary", "print"), ("plot", "plot"))},
    "createNumberMatrix": "graph.number_matrix",
    "toNestedMatrix": "graph.nested_matrix",
    "summaryBbnamFixed": "operators.summaries.summary_bbnam_fixed",
}


#: The parts of a drawing: tables of vertices, segments, loops and whole pictures in two or three dimensions.
DRAWING = {
    "gplotVertex": "gplot_vertex", "gplotArrow": "gplot_arrow", "gplotLoop": "gplot_loop", "gplotTarget": "gplot_target",
    "gplot3d": "gplot3d", "gplot3dArrow": "gplot3d_arrow", "gplot3dLoop": "gplot3d_loop",
}


def _layout(name: str) -> Callable | None:
    """gplotLayout<Mode> and gplot3dLayout<Mode>."""
    from ..operators import layouts

    for prefix, dim in (("gplotLayout", 2), ("gplot3dLayout", 3)):
        mode = name.removeprefix(prefix).lower()
        if name.startswith(prefix) and mode in layouts.MODES:
            return functools.partial(layouts.layout, mode=mode, **({"dim": dim} if dim == 3 else {}))
    return None


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def find(name: str) -> Callable:
    """A function by its camel-case or snake-case name."""
    if name in ALIASES:
        module, *rest = ALIASES[name].rsplit(".", 2) if ALIASES[name].startswith("graph.Graph") else ALIASES[name].rsplit(".", 1)
        out = importlib.import_module(f"arcweave.{module}")
        for part in rest:
            out = getattr(out, part)
        return out
    if name in DRAWING:
        return getattr(importlib.import_module("arcweave.operators.layouts"), DRAWING[name])
    if name in TASKS:
        return TASKS[name]
    if found := _layout(name):
        return found
    for module in MODULES:
        m = importlib.import_module(f"arcweave.{module}")
        for form in (name, _snake(name)):
            if callable(getattr(m, form, None)) or form.isupper() and hasattr(m, form):
                return getattr(m, form)
    raise KeyError(f"no operator named {name}")


def execute_task(name: str, *args, **kwargs):
    return find(name)(*args, **kwargs)


class TaskClient:
    """Runs named tasks one at a time in a thread; a task's jobs carry a tag, by which they are cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.pool, self.tags = spark, ThreadPoolExecutor(1), {}

    def run(self, name: str, *args, action: Callable = lambda x: x, **kwargs) -> Future:
        """A future of action(result); the action (collect, write) is where jobs run."""
        tag = f"task-{uuid.uuid4().hex}"

        def work():
            self.spark.addTag(tag)
            try:
                return action(execute_task(name, *args, **kwargs))
            finally:
                self.spark.removeTag(tag)

        future = self.pool.submit(work)
        self.tags[future] = tag
        return future

    def progress(self) -> dict[int, tuple[int, int]]:
        """stage: (tasks done, tasks) of what runs now."""
        status = self.spark.sparkContext.statusTracker()
        info = {i: status.getStageInfo(i) for i in status.getActiveStageIds()}
        return {i: (x.numCompletedTasks, x.numTasks) for i, x in info.items() if x}

    def cancel(self, future: Future) -> None:
        future.cancel()
        self.spark.interruptTag(self.tags[future])

    def terminate(self) -> None:
        for f in self.tags:
            if not f.done():
                self.cancel(f)
        self.pool.shutdown(wait=False, cancel_futures=True)


#: The execution surface by the names that callers know.
TASKS = {"executeSnaTask": execute_task, "SnaWorkerClient": TaskClient, "createSnaWorker": TaskClient}
