"""The facade: one agent's view of the store."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import agents as A
from .operators import consolidation as C
from .operators import integrity as I
from .operators import memory as M
from .operators import vectors as V
from .operators.vector_index import StoredIndex
from .sources.files import names
from .sources.providers import HashEmbedder
from .sources.store import Store, Transaction
from .verbs import Graph, Identity, Instincts, Procedures, Reflections, Rules, now

__version__ = "0.1.0"


class Agent:
    """Stores, recalls, consolidates and boots one agent; batches go through the operators directly."""

    def __init__(self, spark: SparkSession, name: str, root: str, embedder=None):
        self.spark, self.name, self.embedder = spark, name, embedder or HashEmbedder()
        self.store = Store(spark, root, self.embedder.dimensions).initialize()
        self.guard: I.Guard | None = None
        self.identity, self.rules, self.instincts = Identity(self), Rules(self), Instincts(self)
        self.reflections, self.procedures, self.graph = Reflections(self), Procedures(self), Graph(self)

    now = staticmethod(now)

    def __enter__(self) -> Agent:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.store.close()

    def protect(self, signer) -> I.Guard:
        """From now on memories are sealed with each change, and served only as they were sealed, all columns included."""
        self.guard = I.Guard(f"{self.name}/memories", self.name, signer, I.StoredWitness(self.spark, f"{self.store.root}/_witness"))
        if self.guard.checkpoint is None:
            self.guard.seal(self.store.current("memories"))
        return self.guard

    def _seal(self, old: dict, new: dict) -> None:
        """Seals what a commit will change, ahead of it: if the commit then fails, nothing is served until it is made again."""
        if self.guard is None:
            return
        was, now_ = (self.store.of(x, "memories") for x in (old, new))
        if was == now_:
            return
        batches = now_["batches"][len(was["batches"]) :]
        if not batches:
            return
        touched = self.store._log("memories", batches).filter(F.col("agent").isNull() | (F.col("agent") == self.name))
        blocks = [r["b"] for r in touched.select(F.expr(f"id div {self.guard.block}").alias("b")).distinct().collect()]
        before, after = (self.store._read("memories", x) for x in (was, now_))
        self.guard.reseal(before, after, blocks)

    def verify_integrity(self) -> None:
        """IntegrityError unless the memories are as they were sealed."""
        if self.guard is None:
            raise I.IntegrityError("memories are not protected")
        self.guard.verified(self.store.current("memories"))

    def _mine(self, table: str) -> DataFrame:
        rows = self.store.current(table)
        return self.guard.verified(rows) if table == "memories" and self.guard is not None else rows.filter(F.col("agent") == self.name)

    def remember(self, contents: list[str] | DataFrame, **fields) -> list[int]:
        """Embeds and stores texts (or a DataFrame with a content column); returns the new ids."""
        df = contents if isinstance(contents, DataFrame) else self.spark.createDataFrame([(c,) for c in contents], "content string")
        df = df.withColumn("_k", F.monotonically_increasing_id())
        df = self.embedder.embed(df, "_k", "content", "embedding").withColumn("agent", F.lit(self.name))
        for t in ("created_at", "valid_from", "event_time"):
            df = df.withColumn(t, self.now()) if t not in df.columns else df
        ids = [r["id"] for r in self.store.insert("memories", df.withColumns({k: F.lit(v) for k, v in fields.items()}), self._seal, order="_k").select("id").orderBy("id").collect()]
        return ids

    def recall(self, query: str, *, context: str | list[str] | None = None, as_of=None, **options) -> DataFrame:
        lines = [context] if isinstance(context, str) else context
        q = self.spark.createDataFrame([(0, self.name, query)], "query_id long, agent string, query string")
        q = q.withColumn("query", X.contextualize(F.col("query"), F.array(*[F.lit(x) for x in lines]) if lines else None))
        q = self.embedder.embed(q, "query_id", "query", "query_vec")
        rows = self._mine("memories")
        index = self._index()
        near = index.search(q, options.get("candidates", M.CANDIDATES) or M.CANDIDATES) if index else None
        hits = M.search(rows.withColumnRenamed("embedding", "vec"), q, as_of if as_of is not None else self.now(), near=near, **options)
        return hits.join(rows.select("id", "content", "category", "importance"), "id").orderBy("rank")

    def get(self, memory_id: int) -> DataFrame:
        if self.guard is not None:
            return self.guard.verified_keys(self.store.current("memories"), [memory_id])
        return self._mine("memories").filter(F.col("id") == memory_id)

    def list(self, limit: int = 20, **options) -> DataFrame:
        return M.recent(self._mine("memories"), limit, **options)

    def update(self, memory_id: int, **changes) -> bool:
        """Changes content (embedded anew), importance, category, utility_score, confidence_score or metadata; False if there is no such memory."""
        allowed = {"content", "importance", "category", "utility_score", "confidence_score", "metadata"}
        if bad := set(changes) - allowed:
            raise ValueError(f"cannot change {sorted(bad)}")
        cols = {k: F.lit(v) for k, v in changes.items()}
        if "content" in changes:
            one = self.spark.createDataFrame([(0, changes["content"])], "k long, content string")
            cols["embedding"] = F.lit(self.embedder.embed(one, "k", "content", "embedding").first()["embedding"]).cast("array<float>")
        return self.store.update("memories", (F.col("id") == memory_id) & (F.col("agent") == self.name), cols, self._seal) > 0

    def forget(self, memory_id: int) -> bool:
        return self.store.invalidate([memory_id], self.now(), self.name, self._seal) > 0

    def count(self, category: str = "") -> int:
        return M.matching(M.live(self._mine("memories")), category=category).count()

    def sleep(self, *, dry_run: bool = True, as_of=None) -> DataFrame:
        """The consolidation report; live, the new state is written as one batch, upon the memories that it was made from."""

        def work(t: Transaction) -> DataFrame:
            rows = t.current("memories")
            rows = self.guard.verified(rows) if self.guard is not None else rows.filter(F.col("agent") == self.name)
            out, report = C.run_phases(rows.withColumnRenamed("embedding", "vec"), as_of if as_of is not None else self.now(), dry_run=dry_run)
            if not dry_run:
                t.upsert("memories", out.withColumnRenamed("vec", "embedding"))
            return self.spark.createDataFrame(report.collect(), report.schema)

        return self.store.transact(work, self._seal)

    def build_index(self, engine: str = "auto", cells: int | None = None, probes: int | None = None) -> StoredIndex:
        """Builds the index that `recall` reads from now on, over the agent's live memories with a vector; `exact` has one cell."""
        if engine not in ("auto", "ivf", "exact"):
            raise ValueError(f"unknown index engine {engine!r}")
        mark = self.store.mark("memories")
        cells = 1 if engine == "exact" else cells
        return StoredIndex.build(self._indexed(self._mine("memories")), self._index_path(), self.embedder.dimensions, source=mark, cells=cells, probes=probes)

    def load_index(self) -> StoredIndex:
        """The stored index; StaleIndexError if there is none, it is damaged, or memories have changed since it was written."""
        return StoredIndex.load(self.spark, self._index_path(), self.store.mark("memories"))

    def refresh_index(self) -> StoredIndex:
        """The index as of the memories at hand: what changed since it was written is taken in as postings and tombstones.

        It is built anew if it is damaged or the store was compacted since, so that changes are no longer told apart.
        """
        mark = self.store.mark("memories")
        try:
            index = StoredIndex.load(self.spark, self._index_path())
            if index.state["source"] == mark:
                return index
            new = self.store.since("memories", index.state["source"])
            if new is not None and index.state["dimensions"] == self.embedder.dimensions:
                mine = new.filter(F.col("agent") == self.name)
                return index.change(self._indexed(mine.filter("op = 'upsert'")), mine.select("id"), mark)
        except V.StaleIndexError:
            pass
        return self.build_index()

    def _index(self) -> StoredIndex | None:
        """The index that recall reads, if one was ever built."""
        return self.refresh_index() if names(self.spark, f"{self._index_path()}/state") else None

    def _index_path(self) -> str:
        return f"{self.store.root}/_index/{X.slug_text(self.name)}-{zlib.crc32(self.name.encode()):08x}"

    @staticmethod
    def _indexed(rows: DataFrame) -> DataFrame:
        return M.live(rows).filter(F.col("embedding").isNotNull()).select("id", F.col("embedding").alias("vec"))

    def set_identity(self, personality: str | None = None, ocean: dict[str, float] | None = None) -> None:
        """Sets what is given and keeps the rest; scores must lie in 0..1."""
        if ocean is not None:
            self.identity.set_ocean(ocean)
        self.identity.set(personality)

    def set_rule(self, key: str, content: str, priority: str = "normal") -> None:
        self.rules.set(key, content, priority)

    def reflect(self, thought: str, emotional_state: str = "") -> int:
        return self.reflections.add(thought, emotional_state)

    def route(self, texts: list[str], utility: float = 0.5) -> DataFrame:
        """How texts would be taken in: by the fast path or in full, by what they add to the newest memories."""
        new = self.spark.createDataFrame([(i, self.name, t, float(utility)) for i, t in enumerate(texts)], "cand_id long, agent string, text string, utility double")
        return C.route(self.embedder.embed(new, "cand_id", "text", "vec"), self._mine("memories").withColumnRenamed("embedding", "vec"))

    def boot(self) -> str:
        ident = self._mine("identity")
        if ident.isEmpty():
            ident = self.spark.createDataFrame([(self.name, "", {})], "agent string, personality string, ocean_scores map<string,double>")
        return A.boot_text(ident, self._mine("relationships"), self._mine("rules"), self._mine("inner_monologue")).first()["boot"]

    def snapshot(self) -> dict:
        ident = self.spark.createDataFrame([(self.name,)], "agent string")
        return A.snapshot(ident, self._mine("memories"), self._mine("rules"), self._mine("instincts"), self._mine("inner_monologue")).first().asDict()
