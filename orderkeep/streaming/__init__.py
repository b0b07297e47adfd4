"""orderkeep.streaming"""
