"""Rules, consolidation, graph maintenance, review and evaluation as DataFrame jobs."""
