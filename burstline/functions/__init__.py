"""Column functions: text, scores, stems."""
