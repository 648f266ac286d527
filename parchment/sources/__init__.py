"""Where documents, OCR lines, answers and labels come from."""
