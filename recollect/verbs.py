"""What an agent can do with its identity, rules, instincts, reflections, procedures and graph: verbs over the store."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions import scoring
from .operators import agents as A
from .operators import graph as G
from .sources.scratch import Scratch
from .sources.store import Transaction

if TYPE_CHECKING:
    from .agent import Agent

OCEAN = ("O", "C", "E", "A", "N")


def now() -> Column:
    return F.lit(datetime.now(timezone.utc))


def now_text() -> str:
    """This moment as ISO 8601 in UTC."""
    return datetime.now(timezone.utc).isoformat()


class _Verbs:
    """Verbs on one table: every one reads and writes the rows of its agent alone."""

    table = ""

    def __init__(self, agent: Agent):
        self.agent, self.store, self.spark, self.name = agent, agent.store, agent.spark, agent.name

    def rows(self, table: str = "") -> DataFrame:
        return self.store.current(table or self.table).filter(F.col("agent") == self.name)

    def mine(self, row_id: int) -> Column:
        return (F.col("id") == row_id) & (F.col("agent") == self.name)

    def get(self, row_id: int) -> Row | None:
        return self.rows().filter(F.col("id") == row_id).first()

    def insert(self, **values) -> int:
        row = self.spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()], F.lit(self.name).alias("agent"))
        return self.store.insert(self.table, row).first()["id"]

    def upsert(self, key: dict, values: dict | Callable[[Row | None], dict]) -> Row | None:
        """Replaces the row of `key` by one with `values`; what is not given keeps its value. A new row gets its defaults.

        `values` may be made from the row that is there; it is asked again if another writer changes the table meanwhile.
        Returns the row as it was.
        """
        both = {"agent": self.name} | key

        def work(t: Transaction) -> Row | None:
            old = t.current(self.table)
            names = old.columns
            for k, v in both.items():
                old = old.filter(F.col(k) == v)
            row = old.first()
            given = values(row) if callable(values) else values
            if row is None:
                new = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in both.items()])
                if "id" in names:
                    new = new.withColumn("id", F.lit(t.take_ids(self.table)))
            else:
                new = old.limit(1)
            t.upsert(self.table, new.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()}))
            return row

        return self.store.transact(work)


class Identity(_Verbs):
    table = "identity"

    def get(self) -> Row | None:
        return self.rows().first()

    def set(self, personality: str | None = None, boot_context: str | None = None, philosophy: str | None = None) -> None:
        """Sets what is given (not None) and keeps the rest."""
        given = {"personality": personality, "boot_context": boot_context, "philosophy": philosophy}
        self.upsert({}, {k: v for k, v in given.items() if v is not None} | {"updated_at": now()})

    def ocean(self) -> dict[str, float] | None:
        row = self.get()
        return None if row is None else dict(row["ocean_scores"] or {})

    def set_ocean(self, scores: dict[str, float]) -> None:
        """Scores must lie in 0..1; one that is left out counts as 0.5 for that check only."""
        if not all(0 <= scores.get(k, 0.5) <= 1 for k in OCEAN):
            raise ValueError("OCEAN scores lie between 0 and 1")
        values = F.create_map(*[F.lit(x) for k, v in scores.items() for x in (k, float(v))]) if scores else F.create_map()
        self.upsert({}, {"ocean_scores": values.cast("map<string,double>"), "updated_at": now()})

    def drift(self, deltas: dict[str, float], cap: float | None = None) -> dict[str, float]:
        """Moves each score by its delta, `cap` at most (0 and None: the default), within 0..1; returns the new scores."""
        limit, new = cap or A.DRIFT_CAP, {}

        def move(row: Row | None) -> dict:
            old = dict(row["ocean_scores"] or {}) if row else {}
            new.update({k: round(max(0.0, min(1.0, old.get(k, 0.5) + max(-limit, min(limit, deltas.get(k, 0.0))))), 4) for k in OCEAN})
            return {"ocean_scores": F.create_map(*[F.lit(x) for kv in new.items() for x in kv]), "updated_at": now()}

        self.upsert({}, move)
        return new

    def relationships(self) -> DataFrame:
        return A.relationships_ranked(self.rows("relationships")).orderBy("rank")

    def relate(self, person: str, trust_level: float = 0.5, style: str = "default", dynamic: str = "") -> None:
        other = _Verbs(self.agent)
        other.table = "relationships"
        other.upsert({"person": person}, {"trust_level": float(trust_level), "style": style, "dynamic": dynamic, "updated_at": now()})


class Rules(_Verbs):
    table = "rules"

    def get(self, key: str) -> Row | None:
        return self.rows().filter(F.col("rule_key") == key).first()

    def set(self, key: str, content: str, priority: str = "normal", set_by: str = "system") -> None:
        """Writes a rule and makes it active; one that is there keeps its id and its time."""
        values = {"content": content, "priority": priority, "set_by": set_by, "active": True}
        self.upsert({"rule_key": key}, lambda row: values if row else values | {"created_at": now()})

    def list(self) -> DataFrame:
        return A.rules_list(self.rows()).orderBy("rank")

    def critical(self, limit: int = 5) -> DataFrame:
        return A.rules_critical(self.rows(), limit).orderBy("rank")

    def deactivate(self, key: str) -> bool:
        return self.store.update("rules", (F.col("agent") == self.name) & (F.col("rule_key") == key) & F.col("active"), {"active": F.lit(False)}) > 0


class Instincts(_Verbs):
    table = "instincts"

    def create(self, trigger_pattern: str, action: str, confidence: float = 0.5) -> int:
        return self.insert(trigger_pattern=trigger_pattern, action=action, confidence=float(confidence), created_at=now())

    def list(self, min_confidence: float = 0.0) -> DataFrame:
        return A.instincts_list(self.rows(), min_confidence).orderBy("rank")

    def activate(self, instinct_id: int, times: int = 1) -> bool:
        """Counts activations; each closes a tenth of the gap between confidence and 1."""
        changes = {"confidence": scoring.grown_confidence(F.col("confidence"), times), "activation_count": F.col("activation_count") + times, "last_activated": now()}
        return self.store.update("instincts", self.mine(instinct_id), changes) > 0

    def delete(self, instinct_id: int) -> bool:
        if self.get(instinct_id) is None:
            return False
        self.store.delete("instincts", self.spark.createDataFrame([(instinct_id,)], "id long"))
        return True


class Reflections(_Verbs):
    table = "inner_monologue"

    def add(self, thought: str, emotional_state: str = "", session_id: str = "", turn_number: int = 0) -> int:
        return self.insert(thought=thought, emotional_state=emotional_state, session_id=session_id, turn_number=turn_number, created_at=now())

    def last(self) -> Row | None:
        return A.last_by_agent(self.rows()).first()

    def list(self, limit: int = 10, session_id: str = "") -> DataFrame:
        """The newest thoughts, of one session or of all."""
        mine = self.rows().filter(F.col("session_id") == session_id) if session_id else self.rows().withColumn("session_id", F.lit(""))
        return A.thoughts(mine, limit).orderBy("rank")

    def write_diary(self, content: str, mood: str = "", session_date: date | str | None = None) -> int:
        other = _Verbs(self.agent)
        other.table = "diary"
        return other.insert(content=content, mood=mood, session_date=F.lit(session_date or datetime.now(timezone.utc).date()).cast("date"), created_at=now())

    def last_diary(self) -> Row | None:
        return A.last_by_agent(self.rows("diary")).first()


class Procedures(_Verbs):
    table = "procedural_memories"

    def add(self, task_description: str, workflow: str, task_type: str = "general", facts: str | list | dict = "[]", source_task: str = "", success: bool = True) -> int:
        """Stores how a task was done; its description and workflow are embedded together."""
        row = self.spark.createDataFrame([(0, f"{task_description} {workflow}")], "k long, t string")
        vec = self.agent.embedder.embed(row, "k", "t", "embedding").first()["embedding"]
        facts = facts if isinstance(facts, str) else json.dumps(facts)
        return self.insert(task_description=task_description, workflow=workflow, task_type=task_type, facts=facts, source_task=source_task, success_count=int(success), fail_count=int(not success), embedding=F.lit([float(x) for x in vec]).cast("array<float>"), created_at=now(), updated_at=now())

    def search(self, query: str, top_k: int = 5, task_type: str = "") -> DataFrame:
        """The best procedures as they were found; each of them then counts one hit more."""
        q = self.agent.embedder.embed(self.spark.createDataFrame([(0, self.name, query)], "query_id long, agent string, query string"), "query_id", "query", "query_vec")
        found = A.procedure_search(self.rows().withColumnRenamed("embedding", "vec"), q, top_k, task_type)
        rows = found.join(self.rows().drop("agent"), "id").drop("query_id", "embedding").orderBy("rank")
        out = self.spark.createDataFrame(rows.collect(), rows.schema)  # at most top_k
        hit = [r["id"] for r in out.select("id").collect()]
        if hit:
            self.store.update(self.table, F.col("id").isin(hit) & (F.col("agent") == self.name), {"hit_count": F.col("hit_count") + 1})
        return out

    def record_outcome(self, procedure_id: int, success: bool) -> bool:
        col = "success_count" if success else "fail_count"
        return self.store.update(self.table, self.mine(procedure_id), {col: F.col(col) + 1, "updated_at": now()}) > 0

    def add_reflection(self, procedure_id: int, reflection: str) -> bool:
        return self.store.update(self.table, self.mine(procedure_id), {"reflection": F.lit(reflection), "updated_at": now()}) > 0

    def success_rate(self, procedure_id: int) -> float | None:
        row = self.rows().filter(F.col("id") == procedure_id).select(scoring.success_rate(F.col("success_count"), F.col("fail_count"))).first()
        return row[0] if row else None

    def count(self, task_type: str = "") -> int:
        return (self.rows().filter(F.col("task_type") == task_type) if task_type else self.rows()).count()


class Graph(_Verbs):
    """The agent's graph: similarity edges and mentions, written to the store in place of what was there."""

    def build(self, dry_run: bool = True, domain: str = "") -> str:
        """Counts nodes, edges and entities, or replaces the stored ones; returns the summary."""

        def work(t: Transaction) -> tuple[int, int, int]:
            mine = lambda table: t.current(table).filter(F.col("agent") == self.name)
            mem = mine("memories").withColumnRenamed("embedding", "vec")
            scratch = Scratch(self.spark)
            edges, found = scratch.write(G.similarity_edges(mem, domain=domain), "edges"), scratch.write(G.mentions(mem, domain=domain), "mentions")
            if not dry_run:
                for table, new, key in (("edges", edges, ["agent", "src", "dst", "type"]), ("mentions", found, ["agent", "memory_id", "entity"])):
                    stale = mine(table).select(*key).join(new.select(*key), key, "left_anti")
                    t.upsert(table, new)
                    t.delete(table, stale)
                edges, found = mine("edges"), mine("mentions")
            counts = G.graph_counts(mem, edges, found).filter(F.col("agent") == self.name).first()
            return (counts["nodes"], counts["edges"], counts["entities"]) if counts else (0, 0, 0)

        return G.stats_summary(self.name, *self.store.transact(work), dry_run=dry_run)

    def conflicts(self) -> DataFrame:
        mem = self.rows("memories").withColumnRenamed("embedding", "vec")
        both = G.edge_contradictions(self.rows("edges")).select("agent", "memory_id_a", "memory_id_b", "conflict_type", "similarity")
        return both.unionByName(G.semantic_conflicts(mem).select(*both.columns))
