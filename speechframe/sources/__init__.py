"""Audio, transcripts and model artifacts in; transcript documents and subtitles out."""
