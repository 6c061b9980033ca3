"""Training-data operators: ten stages for text, urls, vectors and audio at corpus scale."""
