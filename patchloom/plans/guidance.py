"""Guidance jobs: index snapshots into the store, retrieve for changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import paths as P
from patchloom.operators import diff as D
from patchloom.operators import filters as L
from patchloom.operators import guidance as U
from patchloom.session import cut_lineage
from patchloom.sources.guidance_store import GuidanceStore


def index_run(sources: DataFrame, store: GuidanceStore, version: int,
              embed=U.fixture_embedder, embedder: str = C.EMBEDDER_NAME) -> None:
    """Replace the guidance of every repository in ``sources``; a repository whose
    snapshot is refused keeps what it has. Items are written out first, since the
    difference to the store and the log both read them."""
    items = cut_lineage(U.index_items(sources))
    accepted = sources.select("repo_id").distinct().join(
        U.refused_snapshots(sources), "repo_id", "left_anti")
    rows = U.replace_snapshot(items, store.read(accepted), accepted, embed, embedder)
    store.write(rows, accepted, version)


def retrieve_run(diffs: DataFrame, heads: DataFrame, store: GuidanceStore, repos: DataFrame,
                 k: int = C.DEFAULT_K, min_similarity: float = C.MIN_SIMILARITY,
                 embed=U.fixture_embedder, embedder: str = C.EMBEDDER_NAME,
                 extra_ignore=()) -> DataFrame:
    """Matches for the reviewable files of all changes; repos: change_id, repo_id.

    Only files with head text (``heads``: change_id, path, content) in an analysed language ask."""
    files = L.reviewable_files(D.diff_files(diffs, with_hunks=True), extra_ignore).filter(
        P.language(F.col("path")).isNotNull()).join(
        heads.filter(F.col("content") != "").select("change_id", "path").distinct(),
        ["change_id", "path"], "left_semi")
    known = store.read(repos.select(F.lower("repo_id").alias("repo_id")))
    return U.retrieve_guidance(U.guidance_queries(D.added_text(files)), known, repos, k,
                               min_similarity, embed, embedder)
