"""The canonical tables of one input snapshot, built lazily.

``Catalog`` is what registered queries use. Derived tables that many queries
start from are built once per input and code version and kept in the shared
store (``sources.store``); all other properties are DataFrame plans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from marquee.operators import activity as A
from marquee.operators import catalogue as C
from marquee.sources import tables as TB


class Catalog:
    """Canonical tables of one input snapshot.

    With ``materialize=True`` (the default) the derivations every query
    starts from -- the normalised films (a per-part supplier ranking over
    ``lineitem``), their last-record-per-id lookup view and the activity log
    (``lineitem`` x ``orders`` + events) --, the current state of every log,
    the graph's edges and the users' film weights
    are built once per snapshot and written as parquet under the shared
    checkpoint folder (``sources.store``, keyed by the input files' names,
    sizes and modification times and by the code); PageRank, communities,
    TF-IDF rows and ALS item factors too. Queries then scan those tables with pruning and
    pushdown. ``materialize=False`` keeps everything as one lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize = materialize
        self.t = TB.DriverTables(spark, sf_dir)

    @cached_property
    def snapshot(self) -> str:
        """Version of the input: a digest of the parquet files' names, sizes
        and modification times (listed through the Hadoop file system)."""
        import hashlib
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        fs = root.getFileSystem(conf)
        it = fs.listFiles(root, True)
        parts = []
        while it.hasNext():
            st = it.next()
            parts.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
        return hashlib.sha1("\n".join(sorted(parts)).encode()).hexdigest()[:16]

    @cached_property
    def store(self):
        """Where derived tables of this input and this code lie, for this session and later ones."""
        from marquee.sources.store import Store, code_version
        return Store(self.spark, f"{self.snapshot}-{code_version()}")

    def _built(self, name: str, build) -> DataFrame:
        if not self.materialize:
            return build()
        return self.store.get_or_build(name, build)

    # --- films -------------------------------------------------------------
    @cached_property
    def items_raw(self) -> DataFrame:
        return TB.items_raw(self.t)

    @cached_property
    def items(self) -> DataFrame:
        return self._built("items", lambda: C.normalize_items(self.items_raw))

    @cached_property
    def items_by_id(self) -> DataFrame:
        return self._built("items_by_id", lambda: C.items_by_id(self.items))

    @cached_property
    def credits(self) -> DataFrame:
        return C.credits(self.items)

    @cached_property
    def credits_by_id(self) -> DataFrame:
        return C.credits(self.items_by_id)

    # --- users and activity --------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        return TB.users(self.t)

    @cached_property
    def activity(self) -> DataFrame:
        return self._built("activity", lambda: TB.activity(self.t))

    @cached_property
    def ratings(self) -> DataFrame:
        return self._built("ratings", lambda: A.ratings_current(self.activity))

    @cached_property
    def likes(self) -> DataFrame:
        return self._built("likes", lambda: A.toggles_current(self.activity, "like"))

    @cached_property
    def favorites(self) -> DataFrame:
        return self._built("favorites", lambda: A.toggles_current(self.activity, "favorite"))

    @cached_property
    def history(self) -> DataFrame:
        return self._built("history", lambda: A.history_current(self.activity))

    @cached_property
    def reviews(self) -> DataFrame:
        return TB.reviews(self.t)

    @cached_property
    def review_replies(self) -> DataFrame:
        return TB.review_replies(self.t)

    @cached_property
    def review_like_log(self) -> DataFrame:
        return TB.review_like_log(self.t)

    @cached_property
    def review_likes(self) -> DataFrame:
        return A.review_likes_current(self.review_like_log)

    @cached_property
    def person_like_log(self) -> DataFrame:
        return self._built("person_like_log", lambda: TB.person_like_log(self.t))

    @cached_property
    def liked_persons(self) -> DataFrame:
        return self._built("liked_persons", lambda: A.person_likes_current(self.person_like_log))

    @cached_property
    def application_log(self) -> DataFrame:
        """All nine tables and the requests to delete from them as one log."""
        return self._built("application_log", lambda: TB.application_log(
            self.users, self.activity, self.t.events, self.reviews, self.review_replies, self.review_like_log, self.person_like_log))

    # --- tables derived from several of these --------------------------------
    @cached_property
    def graph_edges(self) -> DataFrame:
        from marquee.operators import graph as G
        return self._built("graph_edges", lambda: G.graph_edges(self.items))

    @cached_property
    def graph_nodes(self) -> DataFrame:
        from marquee.operators import graph as G
        return self._built("graph_nodes", lambda: G.graph_nodes(self.items, self.graph_edges))

    @cached_property
    def pagerank(self) -> DataFrame:
        """Converged PageRank of the film-attribute graph."""
        from marquee.operators import graph as G
        return self._built("pagerank", lambda: G.pagerank(self.graph_nodes, self.graph_edges))

    @cached_property
    def communities(self) -> DataFrame:
        """Communities of the film-attribute graph by modularity."""
        from marquee.operators import communities as CM
        return self._built("communities", lambda: CM.louvain(self.graph_edges))

    @cached_property
    def tfidf(self) -> DataFrame:
        """TF-IDF rows of the films' content texts."""
        from marquee.operators import content as CT
        return self._built("tfidf", lambda: CT.tfidf(CT.content_text(self.items)))

    @cached_property
    def als(self) -> tuple:
        """ALS model of the current ratings with its figures (C6), trained once per session."""
        from marquee.operators import als as AL
        return AL.als_train(self.ratings)

    @cached_property
    def item_factors(self) -> DataFrame:
        from marquee.operators import als as AL
        return self._built("item_factors", lambda: AL.item_factors(self.als[0]))

    @cached_property
    def user_weights(self) -> DataFrame:
        """Film weights of every user's profile, in 1e-4 units (H2 before its maximum)."""
        from marquee.operators import profiles as H
        signals = H.user_signals(self.ratings, self.likes, self.favorites, self.history, self.liked_persons)
        return self._built("user_weights", lambda: H.user_item_sums(signals, self.credits_by_id,
                                                                   H.movie_info(self.items_by_id)))

    @cached_property
    def report_weights(self) -> DataFrame:
        """Film weights of every user's viewing report (V1)."""
        from marquee.operators import viewing as V
        lists = V.report_inputs(self.ratings, self.likes, self.favorites, self.history, self.liked_persons, self.reviews)
        return self._built("report_weights", lambda: V.report_item_weights(self.items, *lists[:5]))

    # --- persons -------------------------------------------------------------
    @cached_property
    def persons(self) -> DataFrame:
        return TB.persons(self.t)

    @cached_property
    def persons_raw(self) -> DataFrame:
        return TB.persons_raw(self.t)

    # --- other driver tables ------------------------------------------------
    @cached_property
    def pages(self) -> DataFrame:
        return self.t.pages

    @cached_property
    def vectors(self) -> DataFrame:
        return self.t.embeddings
