"""Feature matrices: what the classifier sees of a message, its author and the one before."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scaling import rounded
from ..operators.corpus import Corpus
from ..operators.embedding import default_mean, fit_means, thread_means, width
from ..operators.folds import fits, group_folds, in_folds
from ..operators.profile import (
    default_profile, fallback_values, forum_profile, late_parts, late_vector, message_profiles,
)
from ..operators.skew import lookup_join
from ..schema import N_FOLDS, NO_PARENT, profile_columns
from ..settings import stage, unstage
from ..sources.store import FeatureStore

LEVELS = ["forum", "tree", "branch"]
METHODS = ["behaviour", "embedding", "combined"]
KINDS = {"behaviour": ["behaviour"], "embedding": ["embedding"], "combined": ["behaviour", "embedding"]}
# share of the messages from which an author counts as common; there are fewer than this many
COMMON = 4096
# of the rows per message, besides the blocks
KEYS = ["message_id", "fold", "author"]
MATRIX = "fit int, split string, message_id long, features array<float>"


def as_vector(tags: Column = None) -> Column:
    """Profile columns as one array, in output order."""
    tags = F.col("tags") if tags is None else tags
    return F.concat(
        F.array("duration", "num_comment", "sending_rate", "avg_word_text"),
        tags,
        F.array("diversity", "avg_tag_msg"),
    ).cast("array<float>")


def side_by_side(rows: DataFrame, column: str) -> DataFrame:
    """`rows` sorted where they are.  The condition, always true, keeps the sort, which joins may else drop."""
    return rows.sortWithinPartitions(column).where(F.monotonically_increasing_id() >= 0)


def thrice(vector: Column) -> Column:
    return F.flatten(F.array_repeat(vector, 3))


class Design:
    """Feature matrices of a corpus for all fits of a cross-validation.

    Every matrix is (fit, split, message_id, features) and has one row per message and fit.  What is
    stored has one row per message: blocks that are the same for all fits, and maps from fit to the
    author's values; a matrix is a projection of them.
    """

    def __init__(
        self, corpus: Corpus, embeddings: DataFrame | None = None, n_folds: int = N_FOLDS,
        folds: DataFrame | None = None, store: FeatureStore | None = None,
    ):
        self.corpus = corpus
        self.embeddings = embeddings
        self.n_folds = n_folds
        self._folds = folds
        self._matrices: dict[str, DataFrame] = {}
        self._blocks: dict[str, DataFrame] = {}
        # a store of this corpus, embeddings and folds: matrices in it are read, others are added
        self.store = store

    @cached_property
    def folds(self) -> DataFrame:
        given = self._folds if self._folds is not None else group_folds(self.corpus, self.n_folds)
        return stage(given)

    @cached_property
    def placed(self) -> DataFrame:
        """(message_id, tree_id, parent, author, fold)."""
        return in_folds(self.corpus, self.folds, ["message_id", "tree_id", "parent", "author"])

    @cached_property
    def rows(self) -> DataFrame:
        """(fit, split, message_id, parent, author)."""
        return fits(self.placed, self.n_folds).select(
            "fit", "split", "message_id", "parent", "author"
        )

    @property
    def n_rows(self) -> int:
        return self.corpus.rows * self.n_folds

    # --- behaviour ------------------------------------------------------------------------

    @cached_property
    def forum(self) -> DataFrame:
        """Forum profiles of the training authors of each fit."""
        return stage(forum_profile(self.corpus, self.folds, self.n_folds))

    @cached_property
    def profiles(self) -> DataFrame:
        """Tree and branch profiles of every message for each fit."""
        return message_profiles(
            self.corpus, ["tree", "branch"], self.folds, self.n_folds, forum=self.forum
        )

    @cached_property
    def behaviour_default(self) -> DataFrame:
        """(fit, vector): mean training author, one row per fit."""
        return default_profile(self.forum, len(self.corpus.tags)).select(
            "fit", as_vector().alias("vector")
        )

    def _with_author(self, table: DataFrame, value: Column, name: str, messages: DataFrame | None = None) -> DataFrame:
        """`messages`, by default (message_id, fold, author), and `name`: what `table` (fit, author, ...) says of each message's author, as a
        map from fit to value.  One look-up per message, not one per message and fit."""
        per_author = table.groupBy("author").agg(
            F.map_from_entries(F.collect_list(F.struct("fit", value.alias("v")))).alias(name)  # an entry per fit
        )
        messages = self.placed.select(*KEYS) if messages is None else messages
        return lookup_join(messages, per_author, ["author"], self.corpus.rows, "left", self.corpus.limits)

    def forum_vectors(self) -> DataFrame:
        """Forum profile of each message's author; the default if unseen in training."""
        known = self._with_author(self.forum, as_vector(), "known")
        return fits(known, self.n_folds).join(F.broadcast(self.behaviour_default), "fit").select(
            "fit", "split", "message_id", F.coalesce(F.try_element_at("known", F.col("fit")), "vector").alias("forum"),
            F.col("vector").alias("default"),
        )

    @cached_property
    def behaviour_late(self) -> DataFrame:
        """(fit, behaviour_late): what contexts without history take from the default, one row per fit."""
        return self._late_values(default_profile(self.forum, len(self.corpus.tags)))

    def _late_values(self, profiles: DataFrame) -> DataFrame:
        """(fit, author, behaviour_late): vector, and tags (NULL if they are those of the vector), diversity and
        sum for contexts without history."""
        _, tags, diverse, total = fallback_values(profiles, len(self.corpus.tags))
        other = F.when(~tags.eqNullSafe(F.col("tags")), tags.cast("array<float>"))
        late = F.struct(
            as_vector().alias("v"), other.alias("tags"), diverse.cast("float").alias("diversity"), total.alias("total")
        )
        return profiles.select(*[c for c in ("fit", "author") if c in profiles.columns], late.alias("behaviour_late"))

    @cached_property
    def behaviour_blocks(self) -> DataFrame:
        """One row per message: what is the same for all fits, and a map from fit to the author's values.  Of
        contexts without history only what their own thread says; the rest follows from the author's values."""
        once, new = late_parts(self.corpus, LEVELS[1:])
        profiles = once.select("message_id", "level", as_vector().alias("v")).unionByName(new, allowMissingColumns=True)
        levels = []
        for level in LEVELS[1:]:
            mine = F.col("level") == level
            levels += [F.first(F.when(mine, F.col(c)), True).alias(name) for c, name in (("v", level), ("late", f"{level}_late"))]
        profiles = profiles.groupBy("message_id").agg(*levels)  # a row per level
        # the author's values last, so an author's rows stand side by side and pack well
        rows = self.placed.select(*KEYS).join(profiles, "message_id", "left")
        return self._with_author(self._late_values(self.forum), F.col("behaviour_late"), "forum", rows)

    @staticmethod
    def late_level(late: Column, own: Column, default: Column, n_tags: int) -> Column:
        """The vector of a context without history, by the author's values of a fit or else the default's."""
        def values(of: Column) -> list[Column]:
            return [F.coalesce(of["tags"], F.slice(of["v"], 5, n_tags)), of["diversity"], of["total"]]

        chosen = [F.when(own.isNotNull(), x).otherwise(y) for x, y in zip(values(own), values(default))]
        return F.when(late.isNotNull(), late_vector(late, *chosen))

    def _behaviour_row(self, default: str, of: str = "") -> Column:
        own, n_tags = F.try_element_at(f"{of}forum", F.col("fit")), len(self.corpus.tags)
        late = [self.late_level(F.col(f"{of}{x}_late"), own, F.col("behaviour_late"), n_tags) for x in LEVELS[1:]]
        levels = [F.coalesce(F.col(f"{of}{x}"), late[i], F.col(default)) for i, x in enumerate(LEVELS[1:])]
        return F.concat(F.coalesce(own["v"], F.col(default)), *levels)

    @cached_property
    def behaviour(self) -> DataFrame:
        """3 x 38 numbers: the author in the forum, the thread so far and the branch."""
        return self._put_together("behaviour", self.behaviour_blocks)

    def _put_together(self, method: str, blocks: DataFrame) -> DataFrame:
        """The matrix of a method from one row per message: a projection, made when it is read."""
        rows = self._with_defaults(fits(blocks, self.n_folds), method)
        return rows.select("fit", "split", "message_id", self._row(method).alias("features"))

    def _with_defaults(self, rows: DataFrame, method: str) -> DataFrame:
        """Rows of all fits with the default vectors, one row per fit."""
        for kind in KINDS[method]:
            default = getattr(self, f"{kind}_default").withColumnRenamed("vector", f"{kind}_default")
            rows = rows.join(F.broadcast(default), "fit")
            if kind == "behaviour":
                rows = rows.join(F.broadcast(self.behaviour_late), "fit")
        return rows

    def _row(self, method: str, of: str = "") -> Column:
        """A message's features, from columns whose names begin with `of`."""
        return F.concat(*[getattr(self, f"_{kind}_row")(f"{kind}_default", of) for kind in KINDS[method]])

    # --- embeddings -----------------------------------------------------------------------

    @cached_property
    def width(self) -> int:
        return width(self.embeddings)

    @cached_property
    def means(self) -> DataFrame:
        """(author, which, vectors) of the training authors, see `fit_means`."""
        return stage(fit_means(self.corpus, self.embeddings, self.width, self.folds, self.n_folds))

    @cached_property
    def embedding_default(self) -> DataFrame:
        return default_mean(self.means, self.width).select(
            "fit", F.col("mean").cast("array<float>").alias("vector")
        )

    @cached_property
    def embedding_blocks(self) -> DataFrame:
        """One row per message: mean embeddings of its author in thread and branch, and those in the forum
        with the place of each fit's among them."""
        # written between its two shuffles of vectors, so only one of them is on disk
        self._between = stage(thread_means(self.corpus, self.embeddings, self.width, self.placed.select(*KEYS)))
        return self._with_means(self._between)

    def _with_means(self, rows: DataFrame) -> DataFrame:
        """Rows of messages with `which` and `vectors` of their author, attached last, as rows are wide.  An
        author of more than 1/COMMON of the messages goes by broadcast, so no task gets all of them."""
        table = self.means.withColumn("vectors", F.col("vectors").cast("array<array<float>>"))
        if self.corpus.rows <= self.corpus.limits.hot_rows:
            return rows.join(table, "author", "left")
        counts = self.placed.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
        common = stage(counts.where(F.col("n") * COMMON > self.corpus.rows).where("author IS NOT NULL").select("author"))
        few = table.join(F.broadcast(common), "author").select(
            F.col("author").alias("_author"), F.col("which").alias("_which"), F.col("vectors").alias("_vectors")
        )
        names = common.select(F.col("author").alias("_name"))
        dealt = rows.join(F.broadcast(names), F.col("author") == F.col("_name"), "left").withColumn(
            "_salt", F.when(F.col("author").isNull() | F.col("_name").isNotNull(), 1 + F.abs(F.hash("message_id") % COMMON)).otherwise(F.lit(0))
        ).drop("_name")
        rest = table.withColumn("_salt", F.lit(0))
        found = dealt.join(rest, ["author", "_salt"], "left").join(F.broadcast(few), F.col("author") == F.col("_author"), "left")
        return found.withColumns(
            {"which": F.coalesce("which", "_which"), "vectors": F.coalesce("vectors", "_vectors")}
        ).drop("_salt", "_author", "_which", "_vectors")

    @staticmethod
    def _embedding_row(default: str, of: str = "") -> Column:
        known = F.get(f"{of}vectors", F.get(f"{of}which", F.col("fit")))
        return F.concat(*[F.coalesce(x, F.col(default)) for x in [known, *[F.col(f"{of}mean_{x}") for x in LEVELS[1:]]]])

    @cached_property
    def embedding(self) -> DataFrame:
        """3 x d numbers: mean embedding of the author in the same three contexts."""
        return self._put_together("embedding", self.embedding_blocks)

    @property
    def combined(self) -> DataFrame:
        return self._put_together("combined", self._stored("combined"))

    def _stored(self, method: str) -> DataFrame:
        """The blocks of a method, written on first use: a row per message, whatever the number of fits."""
        if method not in self._blocks:
            if method == "combined":
                self._blocks[method] = self._stored("behaviour").join(self._stored("embedding").drop("fold", "author"), "message_id")
            else:
                name = f"{method}_blocks"
                ours = name not in self.__dict__
                self._blocks[method] = stage(getattr(self, name))
                if ours and method == "embedding":  # nothing else reads what they are made of
                    del self.__dict__[name]
                    unstage(self._between)
        return self._blocks[method]

    def matrix(self, method: str) -> DataFrame:
        """The matrix of a method, put together from blocks that several configurations share.  With a
        store the matrix itself is kept, for other runs."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        if method not in self._matrices:
            if self.store is None:
                found = self._put_together(method, self._stored(method))
            else:
                keys = {"method": method, "fold": f"all_{self.n_folds}", "level": "all", "split": "all"}
                found = self.store.get_or_compute(keys, lambda: getattr(self, method), MATRIX)
            self._matrices[method] = found
        return self._matrices[method]

    # --- last user ------------------------------------------------------------------------

    def default_vector(self, method: str) -> DataFrame:
        """(fit, vector): stands in for a missing last user; one row per fit."""
        if method == "behaviour":
            return self.behaviour_default.select("fit", thrice(F.col("vector")).alias("vector"))
        if method == "embedding":
            return self.embedding_default.select("fit", thrice(F.col("vector")).alias("vector"))
        if method == "combined":
            both = self.default_vector("behaviour").join(
                self.default_vector("embedding").withColumnRenamed("vector", "more"), "fit"
            )
            return both.select("fit", F.concat("vector", "more").alias("vector"))
        raise ValueError(f"unknown method {method!r}")

    @cached_property
    def last_user(self) -> DataFrame:
        """(fit, split, message_id, last_user): parent within the same split, else -1."""
        # one look-up per message; what the parent's split is in each fit follows from its fold
        messages = self.placed.select("message_id", "parent", "fold")
        parents = self.placed.select(F.col("message_id").alias("parent"), F.col("fold").alias("parent_fold"))
        linked = lookup_join(messages, parents, ["parent"], self.corpus.rows, "left", self.corpus.limits)
        same = (F.col("parent_fold") == F.col("fit")) == (F.col("fold") == F.col("fit"))
        return fits(linked, self.n_folds).select(
            "fit", "split", "message_id",
            F.when(same, F.col("parent")).otherwise(F.lit(NO_PARENT)).cast("long").alias("last_user"),
        )

    def last_user_features(self, method: str, features: DataFrame | None = None) -> DataFrame:
        """The feature row of the message answered; the default row where there is none."""
        if features is None and self.store is None and self.corpus.unique:
            if method not in KINDS:
                raise ValueError(f"unknown method {method!r}")
            # joined by message, once for all fits
            rows = fits(self.linked(self._stored(method), ["message_id", "fold"]), self.n_folds)
            rows = self._with_defaults(rows.where("message_id IS NOT NULL"), method)
            return rows.select("fit", "split", "message_id", self._last_row(method, F.col("parent") != NO_PARENT).alias("features"))
        x = self.matrix(method) if features is None else features
        default = F.broadcast(self.default_vector(method))  # one row per fit
        table = x.select("fit", "split", F.col("message_id").alias("last_user"), "features")
        on = ["fit", "split", "last_user"]
        answered = lookup_join(
            self.last_user.where(F.col("last_user") != NO_PARENT), table, on, self.n_rows,
            "inner", self.corpus.limits,
        ).select("fit", "split", "message_id", "features")
        first = self.last_user.where(F.col("last_user") == NO_PARENT).join(default, "fit").select(
            "fit", "split", "message_id", F.col("vector").alias("features")
        )
        return answered.unionByName(first)

    def linked(self, own: DataFrame, columns: list[str]) -> DataFrame:
        """`columns` and parent of each message, with the row of `own` (KEYS and blocks) of the parent, as last_...

        An author's rows are put side by side, so what they share is packed where the rows are dealt next."""
        answered = own.select(*[F.col(c).alias("parent" if c == "message_id" else f"last_{c}") for c in own.columns])
        found = lookup_join(
            self.placed.select(*columns, "parent"), answered, ["parent"], self.corpus.rows, "left", self.corpus.limits
        )
        return side_by_side(found, "last_author").drop("last_author")

    def _last_row(self, method: str, answers: Column = None) -> Column:
        """The features of the message answered, if it is in the same split, else the default ones."""
        fit = F.col("fit")
        same = (F.col("last_fold") == fit) == (F.col("fold") == fit)
        default = F.concat(*[thrice(F.col(f"{kind}_default")) for kind in KINDS[method]])
        return F.when(same if answers is None else same & answers, self._row(method, "last_")).otherwise(default)

    def model_inputs(self, method: str, current: DataFrame) -> DataFrame:
        """(fit, split, message_id, inputs): message embedding, author row, last-user row.

        `current` is (message_id, embedding) of the messages themselves.
        """
        now = current.select("message_id", F.col("embedding").cast("array<float>").alias("now"))
        on = ["fit", "split", "message_id"]
        if self.store is not None:
            x = self.matrix(method)
            last = self.last_user_features(method, x).withColumnRenamed("features", "last")
            return x.join(last, on).join(now, "message_id").select(*on, F.concat("now", "features", "last").alias("inputs"))
        # joined by message, once for all fits; what the parent's split is in each fit follows from its fold
        if method not in KINDS:
            raise ValueError(f"unknown method {method!r}")
        own = self._stored(method)
        linked = self.linked(own, ["message_id"]).drop("parent")
        rows = fits(own.drop("author").join(linked, "message_id").join(now, "message_id"), self.n_folds)
        inputs = F.concat("now", self._row(method), self._last_row(method))
        return self._with_defaults(rows, method).select(*on, inputs.alias("inputs"))


def behaviour_names(tags: list[str]) -> list[str]:
    return [f"{c}_{level}" for level in LEVELS for c in profile_columns(tags)]


def spread(df: DataFrame, array: str, names: list[str], digits: int = 6) -> DataFrame:
    """An array column as named, rounded double columns."""
    return df.selectExpr(
        *[c for c in df.columns if c != array],
        *[
            f"{rounded(f'CAST({array}[{i}] AS DOUBLE)', digits)} + 0.0D AS `{n}`"
            for i, n in enumerate(names)
        ],
    )
