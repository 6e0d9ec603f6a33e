"""Query languages: parsing, analysis and matching."""
