"""siltstone streaming"""
