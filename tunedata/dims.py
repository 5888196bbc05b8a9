"""Fixed dimensions: column synonyms, format labels, chat roles and the task registry."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------------------
# Header words that stand for each canonical field. Order is preference order.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "instruction": ("instruction", "question", "query", "instruct", "task", "talimat", "soru", "görev"),
    "input": ("input", "context", "system", "giriş", "girdi", "bağlam"),
    "output": ("output", "response", "answer", "completion", "target", "çıktı", "cevap", "yanıt"),
    "prompt": ("prompt", "question", "query", "instruction", "istem", "soru"),
    "chosen": ("chosen", "preferred", "accepted", "good", "seçilen", "tercih"),
    "rejected": ("rejected", "dispreferred", "bad", "reddedilen"),
    "completion": ("completion", "response", "output", "answer", "cevap", "yanıt"),
    "label": ("label", "thumbs_up", "is_good", "score", "etiket"),
    "conversations": (
        "conversations", "messages", "dialogue", "dialog", "chat", "turns", "konuşmalar", "mesajlar",
    ),
    "text": ("text", "content", "document", "body", "metin", "içerik"),
    "anchor": ("anchor", "query", "sentence1", "question", "soru"),
    "positive": ("positive", "passage", "sentence2", "answer", "document"),
    "audio": ("audio", "audio_path", "audio_filepath", "wav", "file", "path", "ses"),
    "transcription": ("text", "transcription", "transcript", "sentence", "caption", "metin", "cümle"),
    "image": ("image", "images", "image_path", "img", "picture", "görsel", "resim"),
}

FORMAT_LABELS: dict[str, str] = {
    "alpaca": "Alpaca (instruction / input / output)",
    "sharegpt": "ShareGPT (conversations with from/value turns)",
    "chatml": "ChatML / OpenAI messages (role/content turns)",
    "prompt_completion": "Prompt–completion pairs",
    "preference": "Preference pairs (prompt / chosen / rejected)",
    "kto": "KTO binary feedback (prompt / completion / label)",
    "grpo": "GRPO prompts (prompt, optional answer)",
    "text": "Raw text corpus",
    "embedding_pairs": "Embedding pairs (anchor / positive)",
    "audio_text": "Audio + text (TTS / STT)",
    "vision_chat": "Image + conversation (VLM)",
    "image_text": "Image + ground-truth text (OCR)",
    "unknown": "Unknown — manual mapping required",
}

SHAREGPT_ROLES: dict[str, str] = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "system": "system",
}

AUDIO_EXTENSIONS = ("wav", "mp3", "flac", "m4a", "ogg")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")

STATUS_ICONS: dict[str, str] = {
    "pending": "⏳",
    "running": "🏃",
    "finished": "✅",
    "failed": "❌",
    "stopped": "⏹",
}

ATTENTION_TARGETS = ("q_proj", "k_proj", "v_proj", "o_proj")
ALL_TARGETS = (*ATTENTION_TARGETS, "gate_proj", "up_proj", "down_proj")
# --- end of fixed values ----------------------------------------------------------------


@dataclass(frozen=True)
class Task:
    """One training task: what rows it needs, which formats feed it, its config defaults."""

    id: str
    label: str
    description: str
    trainer: str
    config: str
    dataset_schema: tuple[str, ...]
    detector_formats: tuple[str, ...]
    default_model: str
    modality: str = "text"
    notes: str = ""
    defaults: dict[str, str] = field(default_factory=dict)
    target_modules: tuple[str, ...] = ATTENTION_TARGETS
    loader: str = "FastLanguageModel"
    collator: str | None = None


# --- fixed values -----------------------------------------------------------------------
_LLAMA = "mlx-community/Llama-3.2-1B-Instruct-4bit"
_PREFERENCE_FIELDS = ("prompt", "chosen", "rejected")

TASKS: tuple[Task, ...] = (
    Task(
        "sft", "SFT — Supervised Fine-Tuning",
        "Instruction tuning of chat/completion LLMs on text or conversation data.",
        "SFTTrainer", "SFTConfig", ("text",),
        ("alpaca", "sharegpt", "chatml", "prompt_completion", "text"), _LLAMA,
    ),
    Task(
        "dpo", "DPO — Direct Preference Optimization",
        "Align a model with human preferences from chosen/rejected pairs.",
        "DPOTrainer", "DPOConfig", _PREFERENCE_FIELDS, ("preference",), _LLAMA,
        defaults={"beta": "0.1"},
    ),
    Task(
        "orpo", "ORPO — Odds Ratio Preference Optimization",
        "Reference-free preference optimization; combines SFT and alignment in one pass.",
        "ORPOTrainer", "ORPOConfig", _PREFERENCE_FIELDS, ("preference",), _LLAMA,
        defaults={"beta": "0.1"},
    ),
    Task(
        "simpo", "SimPO — Simple Preference Optimization",
        "Length-normalized, reference-free preference optimization.",
        "SimPOTrainer", "SimPOConfig", _PREFERENCE_FIELDS, ("preference",), _LLAMA,
    ),
    Task(
        "kto", "KTO — Kahneman-Tversky Optimization",
        "Alignment from simple binary thumbs-up/down feedback (no pairs needed).",
        "KTOTrainer", "KTOConfig", ("prompt", "completion", "label"), ("kto",), _LLAMA,
    ),
    Task(
        "grpo", "GRPO — Group Relative Policy Optimization",
        "Online RL with programmable reward functions (reasoning, math, code).",
        "GRPOTrainer", "GRPOConfig", ("prompt",), ("grpo",), _LLAMA,
        notes="Reward functions are plain Python callables; edit them in the generated script.",
    ),
    Task(
        "cpt", "CPT — Continual Pretraining",
        "Inject domain knowledge by continuing pretraining on raw text.",
        "CPTTrainer", "CPTConfig", ("text",), ("text",), "mlx-community/SmolLM2-360M-Instruct",
        defaults={"embedding_learning_rate": "5e-06", "include_embeddings": "true"},
        target_modules=ALL_TARGETS,
    ),
    Task(
        "vlm_sft", "Vision SFT — Vision-Language Models",
        "Fine-tune VLMs (Qwen-VL, LLaVA-style) on image + conversation data.",
        "VLMSFTTrainer", "VLMSFTConfig", ("images", "messages"), ("vision_chat",),
        "mlx-community/Qwen2.5-VL-3B-Instruct-4bit", modality="vision", loader="FastVisionModel",
    ),
    Task(
        "tts_sft", "TTS SFT — Text-to-Speech",
        "Fine-tune speech synthesis models (Orpheus, OuteTTS, CSM…) on audio+text pairs.",
        "TTSSFTTrainer", "TTSSFTConfig", ("audio", "text"), ("audio_text",),
        "mlx-community/orpheus-3b-0.1-ft-bf16", modality="audio",
        notes="Audio training currently supports batch_size=1 (mlx-tune limitation).",
        loader="FastTTSModel", collator="TTSDataCollator",
    ),
    Task(
        "stt_sft", "STT SFT — Speech-to-Text",
        "Fine-tune ASR models (Whisper, Parakeet, Canary…) on audio+transcription pairs.",
        "STTSFTTrainer", "STTSFTConfig", ("audio", "text"), ("audio_text",),
        "mlx-community/whisper-tiny-asr-fp16", modality="audio",
        notes="Audio training currently supports batch_size=1 (mlx-tune limitation).",
        loader="FastSTTModel", collator="STTDataCollator",
    ),
    Task(
        "embedding", "Embedding SFT — Sentence Embeddings",
        "Contrastive fine-tuning of embedding models (anchor/positive pairs).",
        "EmbeddingSFTTrainer", "EmbeddingSFTConfig", ("anchor", "positive"), ("embedding_pairs",),
        "mlx-community/all-MiniLM-L6-v2-bf16",
        defaults={"loss_type": "infonce", "temperature": "0.05"}, loader="FastEmbeddingModel",
    ),
    Task(
        "ocr_sft", "OCR SFT — Optical Character Recognition",
        "Fine-tune OCR models (DeepSeek-OCR, olmOCR…) on image + ground-truth text.",
        "OCRSFTTrainer", "OCRSFTConfig", ("image", "text"), ("image_text",),
        "mlx-community/DeepSeek-OCR-8bit", modality="image",
        defaults={"learning_rate": "5e-05"}, loader="FastOCRModel",
    ),
)
# --- end of fixed values ----------------------------------------------------------------

TASK_BY_ID: dict[str, Task] = {t.id: t for t in TASKS}


def formats_to_tasks() -> dict[str, list[str]]:
    """format -> task ids that list it, in registry order."""
    return {f: [t.id for t in TASKS if f in t.detector_formats] for f in FORMAT_LABELS}


def synonym_ranks() -> dict[str, dict[str, int]]:
    """header word -> {canonical field: rank}; the canonical name itself always ranks 0."""
    ranks: dict[str, dict[str, int]] = {}
    for canonical, words in SYNONYMS.items():
        for rank, word in enumerate((canonical, *words)):
            ranks.setdefault(word, {}).setdefault(canonical, rank)
    return ranks


def synonyms_df(spark: SparkSession) -> DataFrame:
    """(header_key, canonical, rank, is_first): some 120 rows, fixed by this module.

    `is_first` marks one row per header word.
    """
    rows = [
        (word, canonical, rank, i == 0)
        for word, ranks in synonym_ranks().items()
        for i, (canonical, rank) in enumerate(ranks.items())
    ]
    return spark.createDataFrame(
        pa.table({
            "header_key": pa.array([r[0] for r in rows]),
            "canonical": pa.array([r[1] for r in rows]),
            "rank": pa.array([r[2] for r in rows], pa.int32()),
            "is_first": pa.array([r[3] for r in rows]),
        })
    )


def tasks_df(spark: SparkSession) -> DataFrame:
    """The task registry, one row per task, `position` being its listing order."""
    strings = pa.list_(pa.string())
    return spark.createDataFrame(
        pa.table({
            "position": pa.array(range(len(TASKS)), pa.int32()),
            "task": pa.array([t.id for t in TASKS]),
            "task_label": pa.array([t.label for t in TASKS]),
            "description": pa.array([t.description for t in TASKS]),
            "loader": pa.array([t.loader for t in TASKS]),
            "trainer": pa.array([t.trainer for t in TASKS]),
            "config": pa.array([t.config for t in TASKS]),
            "collator": pa.array([t.collator for t in TASKS], pa.string()),
            "dataset_schema": pa.array([list(t.dataset_schema) for t in TASKS], strings),
            "detector_formats": pa.array([list(t.detector_formats) for t in TASKS], strings),
            "default_model": pa.array([t.default_model for t in TASKS]),
            "target_modules": pa.array([list(t.target_modules) for t in TASKS], strings),
            "modality": pa.array([t.modality for t in TASKS]),
            "notes": pa.array([t.notes for t in TASKS]),
            "defaults": pa.array([list(t.defaults.items()) for t in TASKS], pa.map_(pa.string(), pa.string())),
        })
    )


def labels_df(spark: SparkSession) -> DataFrame:
    """(format, format_label)."""
    return spark.createDataFrame(
        pa.table({"format": list(FORMAT_LABELS), "format_label": list(FORMAT_LABELS.values())})
    )
