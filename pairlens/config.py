"""Evaluation configuration: datasets, models and prompt templates.

The configuration is metadata (a handful of entries), so it is parsed on
the driver and enters plans as literals; ``sources.config`` also reads it
as Spark tables for inspection and joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Prompt prefixes, label mappings, model ids and dataset column
# roles that rendered prompts and parsed answers must reproduce exactly.
# ---------------------------------------------------------------------------
PROMPTS = {
    "binary": {
        "nli-zero": {
            "prefix": "Say which is the inference relationship between these two sentences. Please, answer between 'entailment' or 'other'.",
            "label_mapping": {"entailment": "entailment", "other": "not_entailment"},
        },
        "nli-few": {
            "prefix": "Say which is the inference relationship between these two sentences. Please, answer between 'entailment' or 'other'. Here you have some examples: I am open -> I am friendly: entailment. My heart is broken -> I am happy: other.",
            "label_mapping": {"entailment": "entailment", "other": "not_entailment"},
        },
        "qa-zero-ent": {
            "prefix": "Are these two sentences entailed? Please, answer between 'yes' or 'no'",
            "label_mapping": {"yes": "entailment", "no": "not_entailment"},
        },
        "qa-few-ent": {
            "prefix": "Are these two sentences entailed? Please, answer between 'yes' or 'no'. Here you have some examples: I am open -> I am friendly: yes. My heart is broken -> I am happy: no.",
            "label_mapping": {"yes": "entailment", "no": "not_entailment"},
        },
        "chain": {
            "prefix": "You are an expert linguist and your task is to annotate sentences for the task of Natural Language Inference. This task consists in determining if a first sentence (premise) entails or not the second sentence (hypothesis). Please, limit your answer to 'yes' or 'no'. \n Here you have a few examples: \n Premise: I am an open person. \n Hypothesis: I am friendly. \n Answer: yes \n Premise: My heart is broken. \n Hypothesis: I am happy. \n Answer: no.",
            "label_mapping": {"yes": "entailment", "no": "not_entailment"},
        },
    },
    "paraphrase_gen": {
        "instruct": {
            "prefix": "Please, generate a literal paraphrase of this sentence. The sentence contains a metaphorical expression. Your task is to rewrite the sentence so it does not contain any metaphors. The generated sentence must have the same meaning as the original. Please, DO NOT include metaphorical or idiomatic expressions in the generated sentence. Answer only with the literal sentence. ",
        },
    },
}

MODELS = {
    "llama3instruct": "meta-llama/Meta-Llama-3-8B-Instruct",
    "llama3-70b": "meta-llama/Meta-Llama-3-70B",
    "mistral7": "mistralai/Mistral-7B-v0.1",
    "commandr": "command-r-plus-08-2024",
    "qwen-7b": "Qwen/Qwen2.5-7B-Instruct",
    "qwen-72b": "Qwen/Qwen2.5-72B-Instruct",
    "gemma4": "google/gemma-3-4b-it",
    "gemma27": "google/gemma-3-27b-it",
}

DATASETS = {
    "figurative-nli": {"prem_col": "premise", "hyp_col": "hypothesis", "label_col": "label",
                       "prompts": ["binary", "paraphrase_gen"]},
    "flute": {"prem_col": "premise", "hyp_col": "hypothesis", "label_col": "label",
              "prompts": ["binary", "paraphrase_gen"]},
    "impli": {"prem_col": "premise", "hyp_col": "hypothesis", "label_col": "label",
              "prompts": ["binary", "paraphrase_gen"]},
    "fig-qa": {"prem_col": "premise", "hyp_col": "hypothesis", "label_col": "label",
               "prompts": ["binary", "paraphrase_gen"]},
    "meta4xnli": {"prem_col": "sentence1", "hyp_col": "sentence2", "label_col": "gold_label",
                  "prompts": ["binary", "paraphrase_gen"]},
}

# Canonical label domain after preparation, and the label of an unparsable answer.
ENTAILMENT = "entailment"
NOT_ENTAILMENT = "not_entailment"
UNKNOWN = "unk"
# Prompt type whose pair prompt uses the "expert" layout.
EXPERT_PROMPT = "chain"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    prem_col: str = "premise"
    hyp_col: str = "hypothesis"
    label_col: str = "label"
    prompts: tuple = ("binary", "paraphrase_gen")
    data_path: str | None = None
    data_path_paraphrase: str | None = None


@dataclass(frozen=True)
class PromptSpec:
    task: str
    prompt_type: str
    prefix: str
    label_mapping: dict | None = None


@dataclass
class EvalConfig:
    datasets: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    prompts: dict = field(default_factory=dict)   # task -> prompt_type -> PromptSpec

    # -- lookups that fail loudly (the reference silently used empty values) --
    def dataset(self, name: str) -> DatasetSpec:
        if name not in self.datasets:
            raise KeyError(f"unknown dataset {name!r}; configured: {sorted(self.datasets)}")
        return self.datasets[name]

    def model(self, name: str) -> str:
        if name not in self.models:
            raise KeyError(f"unknown model {name!r}; configured: {sorted(self.models)}")
        return self.models[name]

    def prompt(self, task: str, prompt_type: str) -> PromptSpec:
        if task not in self.prompts or prompt_type not in self.prompts[task]:
            raise KeyError(f"unknown prompt {task}/{prompt_type}")
        return self.prompts[task][prompt_type]

    def prompt_types(self, task: str) -> list[str]:
        if task not in self.prompts:
            raise KeyError(f"unknown task {task!r}")
        return list(self.prompts[task])

    @staticmethod
    def from_dict(raw: dict) -> "EvalConfig":
        datasets = {}
        for name, d in (raw.get("datasets") or {}).items():
            datasets[name] = DatasetSpec(
                name=name,
                prem_col=d.get("prem_col", "premise"),
                hyp_col=d.get("hyp_col", "hypothesis"),
                label_col=d.get("label_col", "label"),
                prompts=tuple(d.get("prompts", ())),
                data_path=d.get("data_path"),
                data_path_paraphrase=d.get("data_path_paraphrase"),
            )
        prompts: dict = {}
        for task, by_type in (raw.get("prompts") or {}).items():
            prompts[task] = {}
            for ptype, p in by_type.items():
                # the published config spells the key "preffix"
                prefix = p.get("prefix", p.get("preffix", ""))
                prompts[task][ptype] = PromptSpec(task, ptype, prefix, p.get("label_mapping"))
        return EvalConfig(datasets=datasets, models=dict(raw.get("models") or {}), prompts=prompts)

    @staticmethod
    def from_json(path: str) -> "EvalConfig":
        with open(path, encoding="utf-8") as f:
            return EvalConfig.from_dict(json.load(f))


def default_config() -> EvalConfig:
    return EvalConfig.from_dict({"datasets": DATASETS, "models": MODELS, "prompts": PROMPTS})
