"""Format-aware converters: plain text, subtitles, lyrics, EPUB, DOCX."""
