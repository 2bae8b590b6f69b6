"""Options of the pipelines and their rules."""

from __future__ import annotations

from dataclasses import dataclass

TASKS, TIMESTAMPS, FORMATS = ("transcribe", "translate"), ("chunk", "word"), ("srt", "vtt", "txt")


@dataclass(frozen=True)
class PipelineOptions:
    file_name: str = ""
    device_id: str = "0"
    transcript_path: str = "output.json"
    model_name: str = "base"
    task: str = "transcribe"
    language: str = "None"
    batch_size: int = 24
    timestamp: str = "chunk"
    token: str = "no_token"
    diarization_model: str = ""
    flash: bool = False
    num_speakers: int | None = None
    min_speakers: int | None = None
    max_speakers: int | None = None

    def __post_init__(self):
        for name, value, allowed in (("task", self.task, TASKS), ("timestamp", self.timestamp, TIMESTAMPS)):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        check_speakers(self.num_speakers, self.min_speakers, self.max_speakers)

    @property
    def effective_task(self) -> str:
        """Models for English only transcribe, whatever was asked for."""
        return "transcribe" if self.model_name.rpartition(".")[2] == "en" else self.task

    @property
    def diarize(self) -> bool:
        return self.token != "no_token"

    @property
    def spoken(self) -> str | None:
        return None if self.language == "None" else self.language


def check_speakers(num: int | None, least: int | None, most: int | None) -> None:
    if num is not None and (least is not None or most is not None):
        raise ValueError("num_speakers excludes min_speakers and max_speakers")
    for name, value in (("num_speakers", num), ("min_speakers", least), ("max_speakers", most)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be at least 1")
    if least is not None and most is not None and least > most:
        raise ValueError("min_speakers is larger than max_speakers")
