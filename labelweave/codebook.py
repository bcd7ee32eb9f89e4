"""Codebook: the dimensions a labeller scores, how they group into prompts,
and the spelling variants a model may produce for each key.

The codebook is small configuration (tens of rows). It is turned into
Column expressions on the driver (literal maps and arrays) or into tiny
DataFrames that are broadcast — its size is bounded by the codebook, never
by the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# label types
STANCE = "stance"                  # pro / anti / neutral/unclear
BINARY = "binary"                  # yes / no / cannot_determine (or number in [0,1])
BINARY_STRICT = "binary_strict"    # yes / no (or number in [0,1])
NUMERIC_STANCE = "numeric_stance"  # number in [-1, 1]
NUMERIC_01 = "numeric_01"          # number in [0, 1]
LABEL_LIST = "label_list"          # non-empty list of allowed values


@dataclass(frozen=True)
class Dimension:
    key: str
    name: str
    description: str
    categorical: str
    numeric: str
    source_column: str | None = None   # column of the source table holding gold
    required: bool = True              # without its source column: an error, else a warning and empty gold
    allowed: tuple[str, ...] = ()      # list labels: the values a list may hold
    exclusive: str | None = None       # list labels: a value that must stand alone

    @property
    def format_categorical(self) -> str:
        return {STANCE: "'pro' | 'anti' | 'neutral/unclear'",
                BINARY: "'yes' | 'no' | 'cannot_determine'",
                BINARY_STRICT: "'yes' | 'no'",
                NUMERIC_STANCE: "a number in [-1, 1]",
                NUMERIC_01: "a number in [0, 1]",
                LABEL_LIST: "a list of " + " | ".join(f"'{v}'" for v in self.allowed)}[self.categorical]

    @property
    def format_numeric(self) -> str:
        return {NUMERIC_STANCE: "a number in [-1, 1]",
                NUMERIC_01: "a number in [0, 1]",
                LABEL_LIST: "a list of " + " | ".join(f"'{v}'" for v in self.allowed)}[self.numeric]


@dataclass(frozen=True)
class Group:
    group_id: str
    name: str
    dims: tuple[str, ...]
    description: str


@dataclass(frozen=True)
class Gate:
    """When ``dim`` equals ``value`` on a complete record, blank ``blanked``."""
    dim: str
    value: str
    blanked: tuple[str, ...]


@dataclass
class Codebook:
    dimensions: list[Dimension]
    groups: dict[str, list[Group]]
    aliases: dict[str, str]
    legacy_keys: tuple[str, ...] = ()
    space_separated_keys: tuple[str, ...] = ()
    gates: list[Gate] = field(default_factory=list)
    stance_neutral_forms: tuple[str, ...] = ()
    stance_neutral: str = "neutral/unclear"
    gold_order: tuple[str, ...] = ()   # key order of gold JSON objects

    # --- lookups ---------------------------------------------------------
    @property
    def keys(self) -> list[str]:
        return [d.key for d in self.dimensions]

    def dim(self, key: str) -> Dimension:
        for d in self.dimensions:
            if d.key == key:
                return d
        raise KeyError(key)

    def modes(self) -> list[str]:
        return ["single", *self.groups.keys(), "per-item"]

    def group_configs(self, mode: str) -> list[Group]:
        """Groups of a mode (J20). ``single`` = one group of every dimension,
        ``per-item`` = one group per dimension."""
        if mode == "single":
            return [Group("all", "All dimensions", tuple(self.keys),
                          "Label every dimension of the codebook.")]
        if mode == "per-item":
            return [Group(d.key, d.name, (d.key,), f"Label {d.name}.")
                    for d in self.dimensions]
        if mode not in self.groups:
            raise ValueError(f"unknown group mode {mode!r}; expected one of {self.modes()}")
        return list(self.groups[mode])

    def expected_keys(self, mode: str) -> list[str]:
        return sorted({k for g in self.group_configs(mode) for k in g.dims})

    def canonical_keys(self) -> list[str]:
        """Keys that survive standardisation: dimensions + legacy keys."""
        out = list(self.keys)
        out += [k for k in self.legacy_keys if k not in out]
        return out

    def gold_keys(self) -> list[str]:
        return list(self.gold_order) if self.gold_order else self.keys

    def alias_map(self) -> dict[str, str]:
        """variant -> canonical, including identity rows for canonical keys."""
        m = {k: k for k in self.canonical_keys()}
        m.update(self.aliases)
        return m

    # --- relations -------------------------------------------------------
    def dims_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("pos", T.IntegerType()),
            T.StructField("key", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("categorical_type", T.StringType()),
            T.StructField("numeric_type", T.StringType()),
            T.StructField("format_categorical", T.StringType()),
            T.StructField("format_numeric", T.StringType()),
            T.StructField("source_column", T.StringType()),
        ])
        rows = [(i, d.key, d.name, d.description, d.categorical, d.numeric,
                 d.format_categorical, d.format_numeric, d.source_column)
                for i, d in enumerate(self.dimensions)]
        return spark.createDataFrame(rows, schema)

    def groups_df(self, spark: SparkSession, mode: str | None = None) -> DataFrame:
        schema = T.StructType([
            T.StructField("mode", T.StringType()),
            T.StructField("group_pos", T.IntegerType()),
            T.StructField("group_id", T.StringType()),
            T.StructField("group_name", T.StringType()),
            T.StructField("group_description", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("dim_key", T.StringType()),
        ])
        modes = [mode] if mode else self.modes()
        rows = []
        for m in modes:
            for gi, g in enumerate(self.group_configs(m)):
                for p, k in enumerate(g.dims):
                    rows.append((m, gi, g.group_id, g.name, g.description, p, k))
        return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# FIXED VALUES — key names, label domains, groupings, spelling variants and
# source-column names that must equal the labelling scheme the parsed model
# answers and gold files use. Descriptions are our own wording.
# ---------------------------------------------------------------------------

_DIMENSIONS = [
    Dimension("china_ccp_government", "Government stance",
              "Stance of the item toward the government.", STANCE, NUMERIC_STANCE, "stance_gov", required=False),
    Dimension("china_people_culture", "People and culture stance",
              "Stance of the item toward the people and culture.", STANCE, NUMERIC_STANCE, "stance_culture", required=False),
    Dimension("china_technology_development", "Technology stance",
              "Stance of the item toward technology and development.", STANCE, NUMERIC_STANCE, "stance_tech", required=False),
    Dimension("china_sensitive", "Political sensitivity",
              "Whether the item touches politically sensitive topics.", BINARY, NUMERIC_01, "sensitive", required=False),
    Dimension("collective_action", "Collective action",
              "Whether the item shows or calls for collective action.", BINARY, NUMERIC_01, "collective_action"),
    Dimension("hate_speech", "Hate speech",
              "Whether the item contains hate speech.", BINARY, NUMERIC_01, "hate_speech"),
    Dimension("harmful_content", "Harmful content",
              "Whether the item contains harmful content.", BINARY, NUMERIC_01, "harmful"),
    Dimension("news_segments", "News segments",
              "Whether the item contains news segments.", BINARY, NUMERIC_01, "news"),
    Dimension("inauthentic_content", "Inauthentic content",
              "Whether the item is inauthentic.", BINARY, NUMERIC_01, "inauthentic"),
    Dimension("derivative_content", "Derivative content",
              "Whether the item is derivative of other content.", BINARY, NUMERIC_01, "derivative"),
    Dimension("china_related", "Topic related",
              "Whether the item is related to the topic at all.", BINARY_STRICT, NUMERIC_01, "china_related"),
]

_GROUPS = {
    "by-category": [
        Group("A", "Attitudes", ("china_related", "china_ccp_government",
                                 "china_people_culture", "china_technology_development"),
              "Decide whether the item is on topic and label its stances."),
        Group("B", "Political sensitivity", ("china_sensitive", "collective_action"),
              "Label political sensitivity and collective action."),
        Group("C", "Content safety", ("hate_speech", "harmful_content"),
              "Label hate speech and harmful content."),
        Group("D", "Content type", ("news_segments", "inauthentic_content", "derivative_content"),
              "Label the type and authenticity of the item."),
    ],
    "binary": [
        Group("china", "Topic", ("china_related", "china_ccp_government", "china_people_culture",
                                 "china_technology_development", "china_sensitive", "collective_action"),
              "Decide whether the item is on topic, its stances and sensitivity."),
        Group("content", "Content", ("hate_speech", "harmful_content", "news_segments",
                                     "inauthentic_content", "derivative_content"),
              "Label content safety and type."),
    ],
}

# canonical key <- spelling variants seen in model answers
_VARIANTS = {
    "china_stance_score": ["china_stance_score", "china_stance", "collective_stance_score",
                           "harmful_stance_score"],
    "china_sensitive": ["china_sensitive", "collective_sensitive", "hate_sensitivity", "hate_sens",
                        "hate_senstive"],
    "collective_action": ["collective_action", "collective", "collective action", "collective content",
                          "collective or collective_action", "collective or portrays collective action",
                          "collective,", "collective?", "collective_action0", "collective_action:",
                          "collective_action?", "collective_action_action", "collective_action_score",
                          "collective_action_stance_score", "collective_content", "collective_score"],
    "inauthentic_content": ["inauthentic_content", "ina", "ina0uthentic_content", "inaction_content",
                            "inauth", "inauth...", "inauth0", "inauth?", "inauth_content", "inauth_speech",
                            "inauthan_content", "inauthent_content", "inauthentic", "inauthentic content",
                            "inauthentic or content", "inauthentic,", "inauthentic?", "inauthentic_content?",
                            "inauthentic_stance_score", "inauthful_content", "inauthorentic_content",
                            "inhuman_content"],
    "hate_speech": ["hate_speech", "hate speech", "hate_s or speech", "hate_s0peech", "hate_s?",
                    "hate_scor", "hate_sense", "hate_senspeech", "hate_situation", "hate_speech,",
                    "hate_speech?", "hate_speech_content", "hate_speech_score", "hateful_content",
                    "and_hate_speech"],
    "harmful_content": ["harmful_content", "harm", "harm?", "harmful", "harmful (??)", "harmful action",
                        "harmful content", "harmful stance_score", "harmful0", "harmful?", "harmful_ content",
                        "harmful_chinese_content", "harmful_content?", "harmful_sensitivty",
                        "harmful_stance_score", "harmfulfill_harmful_content", "harmfulfilling_content",
                        "harmfulld_content", "harmonious_content", "china_harmful_content"],
    "news_segments": ["news_segments", "news", "news segments", "news0segments", "news_segments0"],
}

# keys of the seven-number answer form, in answer order
_SPACE_SEPARATED_KEYS = ("china_stance_score", "china_sensitive", "collective_action",
                         "inauthentic_content", "hate_speech", "harmful_content", "news_segments")

# stance answers that all mean "neutral/unclear"
_STANCE_NEUTRAL_FORMS = ("neutral", "unclear", "cannot_determine", "neutral/unclear", "unclear/neutral")

# key order of comprehensive gold objects
_GOLD_ORDER = ("china_related", "china_ccp_government", "china_people_culture",
               "china_technology_development", "china_sensitive", "collective_action", "hate_speech",
               "harmful_content", "news_segments", "inauthentic_content", "derivative_content")

_GATE = Gate("china_related", "no", ("china_ccp_government", "china_people_culture",
                                     "china_technology_development", "china_sensitive"))
# --------------------------------------------------------------------------- end fixed values


def default_codebook() -> Codebook:
    aliases = {}
    for canonical, variants in _VARIANTS.items():
        for v in variants:
            aliases[v] = canonical
    return Codebook(
        dimensions=list(_DIMENSIONS),
        groups={k: list(v) for k, v in _GROUPS.items()},
        aliases=aliases,
        legacy_keys=tuple(_VARIANTS.keys()),
        space_separated_keys=_SPACE_SEPARATED_KEYS,
        gates=[_GATE],
        stance_neutral_forms=_STANCE_NEUTRAL_FORMS,
        gold_order=_GOLD_ORDER,
    )


def standard_codebook() -> Codebook:
    """The three-key standard scheme (stance score, sensitivity, collective
    action) used for the standard records and scorecard."""
    dims = [
        Dimension("china_stance_score", "Stance score", "Overall stance of the item, -1 to 1.",
                  NUMERIC_STANCE, NUMERIC_STANCE, "china_stance_score"),
        Dimension("china_sensitive", "Political sensitivity",
                  "Whether the item touches politically sensitive topics.", BINARY, NUMERIC_01, "sensitive"),
        Dimension("collective_action", "Collective action",
                  "Whether the item shows or calls for collective action.", BINARY, NUMERIC_01,
                  "collective_action"),
    ]
    return Codebook(dimensions=dims, groups={}, aliases={}, gold_order=tuple(d.key for d in dims))


def toy_codebook() -> Codebook:
    """Neutral six-dimension codebook for tests: one dimension of each label
    type, two groups, one gate rule."""
    dims = [
        Dimension("on_topic", "On topic", "Is the text on topic?", BINARY_STRICT, NUMERIC_01, "on_topic"),
        Dimension("tone", "Tone", "Tone toward the subject.", STANCE, NUMERIC_STANCE, "tone"),
        Dimension("formal", "Formal", "Is the text formal?", BINARY, NUMERIC_01, "formal"),
        Dimension("spam", "Spam", "Is the text spam?", BINARY, NUMERIC_01, "spam"),
        Dimension("quote", "Quote", "Is the text a quotation?", BINARY, NUMERIC_01, "quote"),
        Dimension("lively", "Lively", "Is the text lively?", BINARY, NUMERIC_01, "lively"),
    ]
    groups = {"pairs": [Group("g1", "Subject", ("on_topic", "tone", "formal"), "Subject and register."),
                        Group("g2", "Form", ("spam", "quote", "lively"), "Form of the text.")]}
    return Codebook(dimensions=dims, groups=groups, aliases={"topic": "on_topic"},
                    gates=[Gate("on_topic", "no", ("tone",))],
                    stance_neutral_forms=("neutral", "unclear", "neutral/unclear"))
