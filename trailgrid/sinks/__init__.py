"""Writers: lines of JSON, requests for models, tables by name, reports."""
