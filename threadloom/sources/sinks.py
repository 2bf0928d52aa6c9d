"""Records and files that a run leaves: status, previews, configuration, template metadata, imported datasets."""

from __future__ import annotations

import hashlib
import os
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.control import flatten_rows
from threadloom.sources.json_files import atomic_json

#: Lengths of the short and the full preview.
SHORT, FULL = 4000, 20_000


def write_status(path: str, record: dict) -> None:
    """The status record, replaced whole."""
    atomic_json(path, record)


def write_preview(path: str, preview: str | None, full: str | None = None) -> None:
    """``preview`` and ``preview_full``, cut to their lengths; without a full text the short one's source serves for both."""
    text = preview or ""
    atomic_json(path, {"preview": text[:SHORT], "preview_full": (text if full is None else full)[:FULL]})


def write_run_config(run_dir: str, config: dict, device: str, world: int = 1, distributed: bool = False, find_unused: bool = False) -> None:
    """``worker_config.json`` for the workers, and ``train_config.json`` with what the run really uses beside what was asked for.

    Workers always take the run's own template; with gradient checkpointing and a search for unused parameters the graph isn't static.
    """
    worker = {**config, "ddp_find_unused_parameters": find_unused, "force_template": True}
    if worker.get("gradient_checkpointing") and find_unused:
        worker["ddp_static_graph"] = False
    atomic_json(os.path.join(run_dir, "worker_config.json"), worker)
    used = {
        "world_size": world, "ddp_enabled": distributed and world > 1, "ddp_find_unused_parameters": find_unused,
        "template_mode": worker.get("template_mode", "chat"), "force_template": True, "max_history_turns": worker.get("max_history_turns"),
    }
    atomic_json(os.path.join(run_dir, "train_config.json"), {**config, "device": device, "output_dir": run_dir, **{f"effective_{k}": v for k, v in used.items()}})


def write_template_info(folder: str, config: dict, template: str, special: dict, summary: str, skipped: int | None = None) -> None:
    """``template_info.json`` of a saved model: template, special tokens, how samples were packed, and what was skipped if known."""
    record = {
        "template_mode": config.get("template_mode", "chat"), "force_template": config.get("force_template", True), "chat_template": template or "",
        "special_tokens": {k: special.get(k) for k in ("pad_token", "eos_token", "bos_token")}, "max_history_turns": config.get("max_history_turns"),
        "strict_whole_turns": True, "sort_by_length": bool(config.get("sort_by_length", True)), "bucketed_shuffle": True, "use_ngrams": bool(config.get("use_ngrams", False)), "ngram_summary": summary,
    }
    atomic_json(os.path.join(folder, "template_info.json"), record if skipped is None else {**record, "skipped_samples": int(skipped)})


def import_name(dataset: str, split: str, columns: list[str]) -> str:
    """Name of an imported dataset: readable, with a key over all that changes its content."""
    key = hashlib.sha256(f"{dataset}:{split}:row_with_headers:{','.join(columns)}".encode()).hexdigest()[:12]
    return f"hf_{dataset.replace('/', '__').replace(':', '_')}_{split}_text_{key}.csv"


def import_dataset(rows: DataFrame, folder: str, dataset: str, split: str = "train") -> str:
    """Writes each row as one text into a CSV folder of its keyed name, every field quoted; returns its path. One that is there stays."""
    path = f"{folder.rstrip('/')}/{import_name(dataset, split, rows.columns)}"
    target = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(target):
        texts = flatten_rows(rows).select(F.col("text_flat").alias("text"))
        texts.write.mode("overwrite").options(header=True, quoteAll=True, quote='"', escape='"', emptyValue='""').csv(path)
    return path


def hardware(spark: SparkSession) -> dict:
    """What the session runs on: cores, executors, platform and version; GPUs only where the cluster names them as resources."""
    context = spark.sparkContext
    tracker = context._jsc.sc().statusTracker()
    gpus = int(spark.conf.get("spark.executor.resource.gpu.amount", "0"))
    executors = max(1, len(tracker.getExecutorInfos()) - 1)
    return {
        "cuda": gpus > 0, "num_cuda": gpus * executors, "num_cpus": os.cpu_count() or 1, "executors": executors,
        "parallelism": context.defaultParallelism, "platform": platform.platform(), "spark": spark.version,
    }
