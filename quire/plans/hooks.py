"""Progress, messages and stopping of a long action, by job group."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Stopped(RuntimeError):
    """The action was stopped by its hook."""


@dataclass(frozen=True)
class Hooks:
    """progress: tasks done and known so far; say: a message; stop: asked again and again, true ends the action."""

    progress: Callable[[int, int], None] = lambda done, known: None
    say: Callable[[str], None] = lambda message: None
    stop: Callable[[], bool] = lambda: False


def watched(spark: SparkSession, name: str, action: Callable[[], Any], hooks: Hooks, every: float = 0.2) -> Any:
    """What the action returns. Its jobs are a group of their own, so stopping it leaves other jobs alone."""
    group, out = f"{name}-{uuid.uuid4().hex}", {}
    context = spark.sparkContext

    def run() -> None:
        context.setJobGroup(group, name, interruptOnCancel=True)
        try:
            out["value"] = action()
        except Exception as e:  # noqa: BLE001: raised again in the caller's thread
            out["error"] = e

    ended = threading.Event()
    thread = InheritableThread(target=lambda: (run(), ended.set()))
    hooks.say(f"{name}: begun")
    thread.start()
    tracker, done, known = context.statusTracker(), {}, {}
    while not ended.wait(every):
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done[stage], known[stage] = s.numCompletedTasks, s.numTasks
        hooks.progress(sum(done.values()), sum(known.values()))
        if hooks.stop():
            context.cancelJobGroup(group)
            ended.wait()
            hooks.say(f"{name}: stopped")
            raise Stopped(name)
    thread.join()
    if "error" in out:
        hooks.say(f"{name}: failed")
        raise out["error"]
    hooks.say(f"{name}: done")
    return out["value"]
