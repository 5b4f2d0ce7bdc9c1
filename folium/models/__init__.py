"""Plug-ins: OCR engines, vision-language models and image operators."""
