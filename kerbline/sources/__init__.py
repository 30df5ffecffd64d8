"""Wire and file formats: event JSON, MOT text, streams."""
